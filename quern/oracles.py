"""The queries once more in DuckDB's SQL.

Nothing of the engine is imported: token rule, marks, stop words and the stemmer are stated anew, so
that a mistake in the engine's own does not stand on both sides.
"""

from __future__ import annotations

_TOKEN = "\\p{N}+([.,]\\p{N}+)*|[\\p{L}\\p{N}]+([''’][\\p{L}\\p{N}]+)*"
# The English stop words.
_STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can cannot could did do does doing down during each few for from further had has have having he her here hers herself
him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or
other ought our ours ourselves out over own same she should so some such than that the their theirs them themselves
then there these they this those through to too under until up very was we were what when where which while who whom
why will with would you your yours yourself yourselves
""".split()
# Plain letters and the letters with marks that fold to them.
_MARKS = {
    "a": "àáâãäåāă", "c": "çćč", "d": "ðđ", "e": "èéêëēėęě", "i": "ìíîïīį", "l": "ł", "n": "ñńň", "o": "òóôõöøō",
    "r": "ř", "s": "śšş", "t": "ťţ", "u": "ùúûüūů", "y": "ýÿ", "z": "žźż",
    "ae": "æ", "oe": "œ", "ss": "ß", "th": "þ",
}
# Fixed values of the published stemmer: suffixes and replacements of its steps 2 and 3, suffixes of step 4.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def _norm_space(x: str) -> str:
    x = f"replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(0), '')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t\\x{{00a0}}]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    return f"trim(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS})"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(13)"


def stripped(x: str) -> str:
    p = f"replace({x}, '’', '''')"
    return f"CASE WHEN regexp_matches({x}, '[''’]') THEN CASE WHEN regexp_matches({p}, '^.+''s$') THEN left({p}, length({p}) - 2) ELSE replace({p}, '''', '') END ELSE {x} END"


def folded(x: str) -> str:
    out = x
    for plain, marked in _MARKS.items():
        out = f"regexp_replace({out}, '[{marked}]', '{plain}', 'g')"
    return out


def _kinds(x: str) -> str:
    """C for a consonant and V for a vowel, letter by letter: y is a vowel after a consonant."""
    out = f"regexp_replace(translate({x}, 'aeioubcdfghjklmnpqrstvwxz', 'VVVVV{20 * 'C'}'), '^y', 'C')"
    for _ in range(20):  # letters up to 40, each turn settles two of a run of y
        out = f"replace(replace({out}, 'Cy', 'CV'), 'Vy', 'VC')"
    return out


def _suffixed(suffixes: dict[str, str], able) -> str:
    """The longest suffix of x decides; it is replaced if the kinds of what stands before it are `able`."""
    whens = ""
    for s in sorted(suffixes, key=len, reverse=True):
        rest = f"left(x, length(x) - {len(s)})"
        whens += f" WHEN ends_with(x, '{s}') THEN CASE WHEN {able(f'left(f, length(f) - {len(s)})', s)} THEN {rest} || '{suffixes[s]}' ELSE x END"
    return f"CASE{whens} ELSE x END"


def stem(source: str) -> str:
    """(term, stem) of a query that gives distinct terms: the published steps by counts of VC in the words' kinds."""
    count = lambda f: f"((length({f}) - length(replace({f}, 'VC', ''))) / 2)::INT"
    short = lambda x, f: f"(ends_with({f}, 'CVC') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"
    some = lambda f, _: f"contains({f}, 'VC')"
    last, rest, kinds = "right(x, 1)", "left(x, length(x) - 1)", "left(f, length(f) - 1)"
    several = lambda f, s: f"{count(f)} > 1" + (f" AND substr(x, length(x) - {len(s)}, 1) IN ('s', 't')" if s == "ion" else "")
    past = "CASE WHEN ends_with(x, 'eed') THEN 0 WHEN ends_with(x, 'ed') AND contains(left(f, length(f) - 2), 'V') THEN 2 WHEN ends_with(x, 'ing') AND contains(left(f, length(f) - 3), 'V') THEN 3 ELSE 0 END"
    steps = [
        "CASE WHEN ends_with(x, 'sses') OR ends_with(x, 'ies') THEN left(x, length(x) - 2) WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END",
        f"CASE WHEN ends_with(x, 'eed') AND contains(left(f, length(f) - 3), 'VC') THEN {rest} WHEN {past} > 0 THEN left(x, length(x) - {past}) || '+' ELSE x END",
        # after ed or ing, marked by +
        f"""CASE WHEN NOT ends_with(x, '+') THEN x WHEN regexp_matches(x, '(at|bl|iz)\\+$') THEN {rest} || 'e'
            WHEN length(x) > 2 AND x[-2] = x[-3] AND f[-2] = 'C' AND x[-2] NOT IN ('l', 's', 'z') THEN left(x, length(x) - 2)
            WHEN {count(kinds)} = 1 AND {short(rest, kinds)} THEN {rest} || 'e' ELSE {rest} END""",
        f"CASE WHEN {last} = 'y' AND contains({kinds}, 'V') THEN {rest} || 'i' ELSE x END",
        _suffixed(_STEP_2, some),
        _suffixed(_STEP_3, some),
        _suffixed(dict.fromkeys(_STEP_4, ""), several),
        f"CASE WHEN {last} = 'e' AND ({count(kinds)} > 1 OR ({count(kinds)} = 1 AND NOT {short(rest, kinds)})) THEN {rest} ELSE x END",
        f"CASE WHEN ends_with(x, 'll') AND {count('f')} > 1 THEN {rest} ELSE x END",
    ]
    sql = f"SELECT term, term AS x FROM ({source})"
    for step in steps:
        sql = f"SELECT term, {step} AS x FROM (SELECT term, x, {_kinds('x')} AS f FROM ({sql}))"
    return f"SELECT term, CASE WHEN regexp_full_match(term, '[a-z]{{3,}}') THEN x ELSE term END AS stem FROM ({sql})"


_STOPS = ", ".join(f"'{w}'" for w in _STOP_WORDS)
_TERMS = f"length(term) BETWEEN 2 AND 40 AND term NOT IN ({_STOPS})"


def tokens(source: str, keys: str, text: str) -> str:
    """(keys, position, raw)."""
    return f"SELECT {keys}, unnest(range(len(l))) AS position, unnest(l) AS raw FROM (SELECT {keys}, regexp_extract_all({text}, '{_TOKEN}') AS l FROM {source})"


DOCS = f"""
flags AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
c0 AS (SELECT d.doc_id, d.lang, d.source, flags.q, flags.x, {_norm_space("d.text")} AS c FROM documents d LEFT JOIN flags ON d.doc_id = flags.doc_id),
c1 AS (SELECT *, ltrim(split_part(c, chr(10), 1), '# ') AS h, CASE WHEN instr(c, chr(10)) > 0 THEN trim(substr(c, instr(c, chr(10)) + 1), {_BLANKS}) ELSE '' END AS rest FROM c0 WHERE c <> ''),
docs AS (
  SELECT doc_id, lang AS category, source AS author, CASE WHEN rest <> '' THEN rest ELSE c END AS body,
    CASE WHEN length(h) <= 120 THEN h
         WHEN instr(reverse(left(h, 120)), ' ') > 0 AND 120 - instr(reverse(left(h, 120)), ' ') > 60 THEN rtrim(left(h, 120 - instr(reverse(left(h, 120)), ' ')))
         ELSE rtrim(left(h, 120)) END AS title,
    list_filter([lang, CASE WHEN q = 1 THEN 'quality' END, CASE WHEN x = 1 THEN 'toxic' END], lambda t: t IS NOT NULL) AS tags,
    (DATE '2024-01-01' + (doc_id % 366)::INT)::TIMESTAMP AS published_at
  FROM c1)"""

FIELDS = """
f AS (SELECT * FROM (
  SELECT doc_id, 1 AS field_id, title AS content FROM docs UNION ALL SELECT doc_id, 2, array_to_string(tags, ' ') FROM docs UNION ALL SELECT doc_id, 3, body FROM docs) WHERE trim(content) <> '')"""

TOK = f"""
t0 AS ({tokens("f", "doc_id, field_id", "content")}),
t1 AS (SELECT doc_id, field_id, position, {folded("lower(" + stripped("raw") + ")")} AS term FROM t0),
tok AS (SELECT * FROM t1 WHERE {_TERMS}),
lens AS (SELECT f.doc_id, f.field_id, count(tok.term) AS length FROM f LEFT JOIN tok ON f.doc_id = tok.doc_id AND f.field_id = tok.field_id GROUP BY 1, 2)"""


def _post(stemmed: bool) -> str:
    word = "stems.stem" if stemmed else "tok.term"
    join = "JOIN stems ON tok.term = stems.term" if stemmed else ""
    stems = f"stems AS ({stem('SELECT DISTINCT term FROM tok')})," if stemmed else ""
    return f"""{stems}
post AS (
  SELECT {word} AS term, tok.field_id, tok.doc_id, count(*) AS n, least(count(*), 65535) AS tf, least(any_value(lens.length), 65535) AS field_length, list_sort(list(position)) AS positions
  FROM tok {join} JOIN lens ON tok.doc_id = lens.doc_id AND tok.field_id = lens.field_id GROUP BY 1, 2, 3),
terms AS (SELECT term, count(DISTINCT doc_id) AS document_frequency, sum(n)::BIGINT AS total_frequency FROM post GROUP BY 1)"""


STEMMED = f"WITH {DOCS},{FIELDS},{TOK},{_post(True)}"
UNSTEMMED = f"WITH {DOCS},{FIELDS},{TOK},{_post(False)}"

_SCORE = """,
n AS (SELECT count(*) AS n FROM docs),
avgs AS (SELECT field_id, sum(length) / count(*)::DOUBLE AS avg_length FROM lens GROUP BY 1),
boosts(field_id, boost) AS (VALUES (1, 3.0::DOUBLE), (2, 2.0::DOUBLE), (3, 1.0::DOUBLE)),
idfs AS (SELECT term, {idf} AS idf FROM terms, n)"""
_BM25_IDF = "ln(1 + (n - document_frequency + 0.5::DOUBLE) / (document_frequency + 0.5::DOUBLE))"
_TFIDF_IDF = "1 + ln(n / (1 + document_frequency)::DOUBLE)"


def _bm25(idf: str, tf: str, length: str) -> str:
    return f"({idf} * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (CASE WHEN avg_length > 0 THEN {length} / avg_length ELSE 1 END))) * boost)"


def _tfidf(idf: str, tf: str, length: str) -> str:
    return f"(sqrt({tf}::DOUBLE) * {idf} * {idf} * (CASE WHEN {length} > 0 THEN 1 / sqrt({length}::DOUBLE) ELSE 1 END) * boost)"


def prefix(model: str = "bm25") -> str:
    return STEMMED + _SCORE.replace("{idf}", _BM25_IDF if model == "bm25" else _TFIDF_IDF)


def term(t: str, field: int | None = None, model: str = "bm25") -> str:
    """(doc_id, s) of a term clause."""
    score = (_bm25 if model == "bm25" else _tfidf)("idf", "tf", "field_length")
    return f"SELECT doc_id, sum({score}) AS s FROM post JOIN idfs USING (term) JOIN avgs USING (field_id) JOIN boosts USING (field_id) WHERE term = '{t}'{f' AND field_id = {field}' if field else ''} GROUP BY doc_id"


def many(condition: str) -> str:
    """(doc_id, s) of an expansion to the first 64 terms of a condition."""
    return f"SELECT doc_id, sum({_bm25('idf', 'tf', 'field_length')}) AS s FROM post JOIN idfs USING (term) JOIN avgs USING (field_id) JOIN boosts USING (field_id) WHERE term IN (SELECT term FROM terms WHERE {condition} ORDER BY document_frequency DESC, term LIMIT 64) GROUP BY doc_id"


def phrase(words: list[tuple[str, int]], field: int | None = None) -> str:
    """Self-join of positions: places of the first word where the others follow at their offsets."""
    a, _ = words[0]
    joins = "".join(f" JOIN pos p{k} ON p0.doc_id = p{k}.doc_id AND p0.field_id = p{k}.field_id AND p{k}.position = p0.position + {o} AND p{k}.term = '{w}'" for k, (w, o) in enumerate(words) if k)
    idf = " + ".join(f"(SELECT idf FROM idfs WHERE term = '{w}')" for w, _ in words)
    hits = f"SELECT p0.doc_id, p0.field_id, count(*) AS tf, any_value(p0.field_length) AS field_length FROM pos p0{joins} WHERE p0.term = '{a}'{f' AND p0.field_id = {field}' if field else ''} GROUP BY 1, 2"
    pos = "SELECT doc_id, field_id, term, field_length, unnest(positions) AS position FROM post WHERE term IN (" + ", ".join(f"'{w}'" for w, _ in words) + ")"
    return f"SELECT doc_id, 2.0::DOUBLE * sum({_bm25('(' + idf + ')', 'tf', 'field_length')}) AS s FROM (WITH pos AS ({pos}) {hits}) JOIN avgs USING (field_id) JOIN boosts USING (field_id) GROUP BY doc_id"


def both(parts: list[str]) -> str:
    return f"SELECT doc_id, sum(s) AS s FROM ({' UNION ALL '.join(f'({p})' for p in parts)}) GROUP BY doc_id HAVING count(*) = {len(parts)}"


def either(parts: list[str], coordination: bool = True) -> str:
    scale = f" * count(*) / {len(parts)}" if coordination else ""
    return f"SELECT doc_id, sum(s){scale} AS s FROM ({' UNION ALL '.join(f'({p})' for p in parts)}) GROUP BY doc_id"


def search(sql: str, model: str = "bm25", where: str = "true") -> str:
    return f"{prefix(model)} SELECT doc_id, round(s::DOUBLE, 6) AS score FROM ({sql}) WHERE {where}"


def _searches() -> dict[str, str]:
    h, b, t = term("heat"), term("ble"), term("thon")
    en = "doc_id IN (SELECT doc_id FROM docs WHERE category = 'en')"
    ph = phrase([("erin", 0), ("thanea", 1)])
    return {
        "bm25_term": search(h),
        "bm25_field_term": search(term("heat", 1)),
        "tfidf_term": search(term("heat", model="tfidf"), "tfidf"),
        "tfidf_or": search(either([term("heat", model="tfidf"), term("ble", model="tfidf")]), "tfidf"),
        "bool_and": search(both([h, b])),
        "bool_or_coord": search(either([h, b, t])),
        "bool_or_plain": search(either([h, b, t], False)),
        "bool_unknown_optional": search(h),
        "bool_required_optional": search(f"SELECT m.doc_id, m.s + coalesce(o.s, 0) AS s FROM ({h}) m LEFT JOIN ({either([b, t], False)}) o ON m.doc_id = o.doc_id"),
        "bool_not": search(f"SELECT * FROM ({h}) WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term IN ('ble', 'thon'))"),
        "bool_nested": search(f"SELECT * FROM ({both([either([h, b]), either([t, term('inor')])])}) WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'est')"),
        "bool_stop_word_required": search(f"SELECT * FROM ({h}) WHERE false"),
        "negation_in_filter": search("SELECT doc_id, 1.0::DOUBLE AS s FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'heat')", where=en),
        "match_all": search("SELECT doc_id, 1.0::DOUBLE AS s FROM docs"),
        "phrase_exact": search(ph),
        "phrase_field": search(phrase([("erin", 0), ("thanea", 1)], 1)),
        "phrase_stopword_gap": search(phrase([("th", 0), ("en", 2)])),
        "phrase_and_term": search(either([ph, h])),
        "prefix_search": search(many("starts_with(term, 'heat')")),
        "wildcard_search": search(many("regexp_full_match(term, 'h.at.*n')")),
        "search_filtered": search(either([h, b]), where=en + " AND doc_id IN (SELECT doc_id FROM docs WHERE list_contains(tags, 'quality'))"),
    }


def _filters() -> dict[str, str]:
    where = {
        "filter_category": "category IN ('en', 'fr')",
        "filter_author": "author IN ('src1', 'src7')",
        "filter_tags_any": "list_has_any(tags, ['quality', 'toxic'])",
        "filter_tags_all": "list_has_all(tags, ['en', 'quality'])",
        "filter_dates": "published_at >= TIMESTAMP '2024-03-01' AND published_at <= TIMESTAMP '2024-06-30'",
        "filter_combined": "category IN ('en', 'de') AND author IN ('src1', 'src2', 'src3') AND list_contains(tags, 'quality') AND published_at >= TIMESTAMP '2024-02-01'",
    }
    return {k: f"WITH {DOCS} SELECT doc_id FROM docs WHERE {w}" for k, w in where.items()}


_LOGS = "WITH logs AS (SELECT event_type || ' ' || (user_id % 7)::VARCHAR AS query, event_type || ' ' || (user_id % 7)::VARCHAR AS normalised, event_id % 5 AS hit_count, floor(value * 1000)::BIGINT AS took_us, ts FROM events)"
_RAW = f"SELECT DISTINCT raw AS token FROM ({tokens('documents', 'doc_id', 'text')})"
_PLAIN_TERMS = f"SELECT * FROM (SELECT doc_id, position, {folded('lower(' + stripped('raw') + ')')} AS term FROM ({tokens('documents', 'doc_id', 'text')})) WHERE {_TERMS}"
#: The changed batch of index_after_upsert: docs with the added words, ids that are new, and what is left of the old.
_UPSERTED = """
up AS (
  SELECT CASE WHEN doc_id % 10 = 9 THEN -1 - doc_id ELSE doc_id END AS doc_id, category, author, CASE WHEN doc_id % 3 = 0 THEN body || ' freshword heat' ELSE body END AS body, title, tags, published_at
  FROM docs0 WHERE doc_id % 3 <> 2),
docs AS (SELECT * FROM docs0 WHERE doc_id NOT IN (SELECT doc_id FROM up) UNION ALL SELECT * FROM up)"""


def all_sql() -> dict[str, str]:
    facet = lambda value: f"{STEMMED}, v AS (SELECT {value} AS value FROM docs WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'heat')) SELECT value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"
    dated = lambda order: f"{STEMMED}, d AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN published_at END AS p FROM docs WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'heat')) SELECT doc_id, 0.0::DOUBLE AS score FROM d ORDER BY {order} LIMIT 20 OFFSET 5"
    two = either([term("heat"), term("ble")])
    out = {
        "tokenize_counts": f"SELECT raw AS token, count(*) AS n, count(DISTINCT doc_id) AS df FROM ({tokens('documents', 'doc_id', 'lower(text)')}) GROUP BY 1",
        "tokenize_positions": f"SELECT conv_id, turn, position, raw AS token FROM ({tokens('conversations', 'conv_id, turn', 'text')})",
        "tokenize_offsets": f"""WITH g AS (SELECT doc_id, regexp_split_to_array(text, '{_TOKEN}') AS g, regexp_extract_all(text, '{_TOKEN}') AS l FROM documents),
            r AS (SELECT doc_id, unnest(range(len(l))) AS position, unnest(l) AS token, unnest(g[:len(l)]) AS gap FROM g),
            s AS (SELECT *, sum(strlen(gap) + strlen(token)) OVER (PARTITION BY doc_id ORDER BY position) AS e FROM r)
            SELECT doc_id, position, token, (e - strlen(token))::BIGINT AS start, e::BIGINT AS stop FROM s""",
        "strip_apostrophes": f"SELECT token, {stripped('token')} AS stripped FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents)",
        "fold_ascii": f"SELECT token, {folded('lower(token)')} AS folded FROM ({_RAW})",
        "normalise_terms": f"SELECT token, {folded('lower(' + stripped('token') + ')')} AS term FROM ({_RAW})",
        "length_stop_filter": f"SELECT doc_id, term, position FROM ({_PLAIN_TERMS})",
        "minimal_analyzer": f"SELECT p_partkey, lower(raw) AS term, position FROM ({tokens('part', 'p_partkey', 'p_name')})",
        "porter_stems": stem(f"SELECT DISTINCT term FROM ({_PLAIN_TERMS})"),
        "stream_aggregates": f"SELECT doc_id, term, count(*) AS frequency, string_agg(position, ',' ORDER BY position) AS positions FROM ({_PLAIN_TERMS}) GROUP BY 1, 2",
        "query_normalise": "SELECT DISTINCT text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalised FROM conversations",
        "media_types": "SELECT event_id, ['text/html', 'text/plain', 'text/markdown', 'application/json', 'application/pdf', 'text/plain'][(event_id % 6 + 1)::INT] AS media_type FROM events",
        "parse_text_docs": f"WITH {DOCS} SELECT doc_id, title, body FROM docs",
        "parse_json_props": "SELECT event_id, event_type AS title, user_id::VARCHAR AS author, 'a|b' AS tags FROM events",
        "clean_metadata": "SELECT doc_id, lang || '|' || source AS tags FROM documents",
        "checksums": "SELECT true AS same, count(*) AS n FROM documents",
        "postings": f"{STEMMED} SELECT term, field_id::BIGINT AS field_id, doc_id, tf, field_length, array_to_string(positions, ',') AS positions FROM post",
        "postings_without_positions": f"{UNSTEMMED} SELECT term, sum(tf)::BIGINT AS tf FROM post GROUP BY 1",
        "term_dictionary": f"{STEMMED} SELECT * FROM terms",
        "term_dictionary_unstemmed": f"{UNSTEMMED} SELECT * FROM terms",
        "field_lengths": f"{STEMMED} SELECT doc_id, field_id::BIGINT AS field_id, length FROM lens",
        "collection_stats": f"{STEMMED} SELECT field_id::BIGINT AS field_id, count(*) AS documents, round(avg(length), 2) AS average_length FROM lens GROUP BY 1",
        "index_statistics": f"{STEMMED} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM terms) AS terms, (SELECT count(*) FROM post) AS postings, (SELECT sum(length)::BIGINT FROM lens) AS tokens, round((SELECT sum(length) FROM lens) / (SELECT count(*) FROM post)::DOUBLE, 2) AS tokens_per_posting",
        "upsert_status": f"WITH {DOCS} SELECT CASE WHEN doc_id % 10 = 9 THEN 'n' ELSE '' END || doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 10 = 9 THEN 'created' WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM docs WHERE doc_id % 3 <> 2",
        "index_after_upsert": f"WITH {DOCS.replace(chr(10) + 'docs AS (', chr(10) + 'docs0 AS (')},{_UPSERTED},{FIELDS},{TOK},{_post(False)} SELECT * FROM terms",
        "index_after_delete": f"{UNSTEMMED} SELECT term, count(DISTINCT CASE WHEN doc_id >= 20 THEN doc_id END) AS document_frequency, sum(CASE WHEN doc_id >= 20 THEN n ELSE 0 END)::BIGINT AS total_frequency FROM post GROUP BY 1",
        "topk_paged": f"{prefix()} SELECT doc_id, round(s, 6) AS score FROM ({two}) ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10",
        "top_summary": f"{prefix()} SELECT count(*) AS total, round(max(s), 6) AS max_score FROM ({two})",
        "published_range": f"WITH {DOCS} SELECT min(published_at) AS earliest, max(published_at) AS latest FROM docs",
        "suggest_terms": f"{STEMMED} SELECT term, document_frequency AS documents, 'Thé ' || term AS query FROM terms WHERE starts_with(term, 'hea') ORDER BY document_frequency DESC, term LIMIT 8",
        "popular_queries": f"{_LOGS} SELECT normalised AS query, count(*) AS searches FROM logs WHERE hit_count > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "popular_with_prefix": f"{_LOGS} SELECT normalised AS query, count(*) AS searches FROM logs WHERE hit_count > 0 AND starts_with(normalised, 'c') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        "log_statistics": f"{_LOGS} SELECT count(*) AS total, round(avg(took_us) / 1000, 3) AS average_ms, round(max(took_us) / 1000.0::DOUBLE, 3) AS slowest_ms, sum((hit_count = 0)::INT)::BIGINT AS empty_results FROM logs",
        "recent_queries": f"{_LOGS} SELECT query, hit_count, took_us FROM logs ORDER BY ts DESC, query, took_us LIMIT 20",
        "explain_hits": f"{prefix()} SELECT doc_id, 0::BIGINT AS clause, round(s, 6) AS contribution FROM ({term('heat')}) UNION ALL SELECT doc_id, 1, round(s, 6) FROM ({term('ble')})",
        "explain_page": f"{prefix()}, parts AS (SELECT doc_id, 'heat' AS term, s FROM ({term('heat')}) UNION ALL SELECT doc_id, 'ble', s FROM ({term('ble')})), page AS (SELECT doc_id, s AS total FROM ({two}) ORDER BY round(s, 6) DESC, doc_id LIMIT 20) SELECT doc_id, term, round(s::DOUBLE, 6) AS contribution, round(total::DOUBLE, 6) AS score FROM parts JOIN page USING (doc_id)",
        "prefix_expand": f"{STEMMED} SELECT term, document_frequency FROM terms WHERE starts_with(term, 'hea') ORDER BY document_frequency DESC, term LIMIT 64",
        "wildcard_expand": f"{STEMMED} SELECT term, document_frequency FROM terms WHERE regexp_full_match(term, 'h.*a.') ORDER BY document_frequency DESC, term LIMIT 64",
        "sort_newest": dated("p DESC NULLS LAST, doc_id DESC"),
        "sort_oldest": dated("p ASC NULLS FIRST, doc_id ASC"),
        "facet_categories": facet("category"),
        "facet_tags": facet("unnest(list_distinct(tags))"),
        "facet_authors": facet("author"),
    }
    return out | _searches() | _filters()
