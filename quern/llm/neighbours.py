"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.llm.common import cut, row_ids, table

#: Tables, projections of a table, and the width of a slot in projected standard deviations.
TABLES, PROJECTIONS, WIDTH = 4, 4, 1.0
#: The probes of a query are fitted on this many vectors at most (least hashes of the id), to this recall on the sample.
SAMPLE, RECALL = 4096, 0.97
#: Index rows that one block should hold.
BLOCK = 65_536
#: Groups up to which their block counts are broadcast.
MAPPED = 1 << 20
_STEPS = np.array(list(product(range(-2, 3), repeat=PROJECTIONS)), np.int64)


@dataclass
class Index:
    """h(x) = floor((a . [x/M, sqrt(1 - |x|^2/M^2)] + b) / w): by that lift, near in Euclid means a large inner product."""

    norm: float
    a: np.ndarray  # TABLES x PROJECTIONS x (d + 1)
    b: np.ndarray
    width: float
    probes: int
    groups: int

    def slots(self, x: np.ndarray, query: bool) -> np.ndarray:
        length = np.sqrt((x * x).sum(1))
        if query:
            lifted = np.concatenate([x / length[:, None], np.zeros((len(x), 1))], 1)
        else:
            lifted = np.concatenate([x / self.norm, np.sqrt(np.maximum(0, 1 - (length / self.norm) ** 2))[:, None]], 1)
        return (np.einsum("nd,tpd->ntp", lifted, self.a) + self.b) / self.width

    @staticmethod
    def codes(cells: np.ndarray) -> np.ndarray:
        """Table and cell as one long: (n, TABLES, ..., PROJECTIONS) to (n, TABLES, ...)."""
        out = np.zeros(cells.shape[:-1], np.int64)
        for p in range(PROJECTIONS):
            out = (out << 12) | ((cells[..., p] + 2048) & 4095)
        shape = [1, TABLES] + [1] * (out.ndim - 2)
        return out | (np.arange(TABLES, dtype=np.int64).reshape(shape) << 48)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.codes(np.floor(self.slots(x, False)).astype(np.int64))

    def visits(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """(n, TABLES, probes) codes: cells about the query, the likeliest first by squared distance to their near walls."""
        f = self.slots(x, True)
        cell = np.floor(f).astype(np.int64)
        r = f - cell
        far = np.stack([r + 1, r, np.zeros_like(r), 1 - r, 2 - r], -1) ** 2  # (n, t, p, 5)
        cost = sum(far[:, :, p][:, :, _STEPS[:, p] + 2] for p in range(PROJECTIONS))
        order = np.argsort(cost, -1, kind="stable")[:, :, : probes or self.probes]
        return self.codes(cell[:, :, None, :] + _STEPS[order])


def _vectors(df: DataFrame, ident: str, vector: str) -> tuple[DataFrame, int, float, int]:
    """(id, x, row) of the rows that take part, their dimension, largest norm and number."""
    x = F.col("x")
    fine = x.isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = row_ids(df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))).select("id", "x", F.col("_row").alias("row")).where(F.col("id").isNotNull() & fine)
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("m")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows, 1, 1.0, 0
    return rows.where(F.size("x") == sizes[0]["d"]), sizes[0]["d"], float(np.sqrt(sizes[0]["m"])), sizes[0]["n"]


def build(rows: DataFrame, d: int, norm: float, n: int, k: int, seed: int = 3, sample: int = SAMPLE, recall: float = RECALL) -> Index:
    """Projections are drawn; the number of probes is fitted: the least that finds `recall` of the sample's true neighbours in the sample."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(TABLES, PROJECTIONS, d + 1))
    width = WIDTH
    b = rng.uniform(0, width, (TABLES, PROJECTIONS))
    index = Index(norm, a, b, width, len(_STEPS), max(12, -(-n * TABLES // BLOCK)))
    got = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(sample).select("x").toArrow().column("x").combine_chunks()
    x = np.unique(got.values.to_numpy(zero_copy_only=False).reshape(-1, d), axis=0) if len(got) else np.empty((0, d))
    if len(x) < 2:
        return index
    q = x[:: max(1, len(x) // 256)]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(0, len(x), max(1, len(x) // 256))] = -np.inf
    near = np.argsort(-s, 1)[:, : min(k, len(x) - 1)]
    home, visits = index.home(x), index.visits(q)
    first = np.full(near.shape, len(_STEPS))
    for t in range(TABLES):
        for i in range(len(q)):
            where = {c: p for p, c in reversed(list(enumerate(visits[i, t].tolist())))}
            first[i] = np.minimum(first[i], [where.get(c, len(_STEPS)) for c in home[near[i], t].tolist()])
    index.probes = int(min(len(_STEPS), np.quantile(first, recall) + 1))
    return index


def _place(index: Index, query: bool):
    """Rows (id, x, row) to (g, codes, id, x, row): homes of the index rows, or the cells that a query visits, by group."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for k in range(0, len(x), 256):
                part = x[k : k + 256]
                codes = index.visits(part) if query else index.home(part)
                codes = codes.reshape(len(part), -1)
                mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                group = ((mixed >> np.uint64(33)) % np.uint64(index.groups)).astype(np.int32)
                order = np.argsort(group, 1, kind="stable")
                rows, g_out, c_out = [], [], []
                for i in range(len(part)):
                    g, c = group[i, order[i]], codes[i, order[i]]
                    cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    for a, z in zip(cuts, np.append(cuts[1:], len(g)), strict=True):
                        rows.append(k + i)
                        g_out.append(int(g[a]))
                        c_out.append(c[a:z])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(g_out, pa.int32()), pa.array(c_out, pa.list_(pa.int64())), *(batch.column(c).take(take) for c in range(3))], ["g", "codes", "id", "x", "row"])

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one vector with many, summed in one order, so that equal vectors have equal scores."""
    out = np.zeros(len(x))
    for d in range(len(q)):
        out += q[d] * x[:, d]
    return out


def _rank(k: int):
    """Blocks sorted by (g, salt, side): index rows first, then the queries that visit any of their cells."""

    def score(x, ids, rows, codes, q, qid, qrow, qcodes):
        import pyarrow as pa

        cells, inv = np.unique(codes, return_inverse=True)
        out: list[list] = [[], [], [], [], []]
        for s in range(0, len(q), 64):
            rough = q[s : s + 64] @ x.T
            for i in range(len(rough)):
                j = s + i
                if len(qcodes[j]):
                    at = np.minimum(np.searchsorted(cells, qcodes[j]), len(cells) - 1)
                    ok = np.zeros(len(cells), bool)
                    ok[at[cells[at] == qcodes[j]]] = True
                else:  # all rows, each in its cell of the first table
                    ok = cells >> 48 == 0
                some = np.flatnonzero(ok[inv] & (rows != qrow[j]))
                if not len(some):
                    continue
                r = rough[i, some]
                if len(r) > 2 * k:  # a row may stand in two of the block's cells: 2 k rows hold k ids
                    kth = np.partition(r, len(r) - TABLES * k)[len(r) - TABLES * k] if len(r) > TABLES * k else r.min()
                    some = some[r >= kth - 1e-9 * (1 + abs(kth))]
                some = some[np.unique(rows[some], return_index=True)[1]]
                sc = exact(q[j], x[some])
                top = best(sc, ids[some], k)
                for o, v in zip(out, ([int(qrow[j])] * len(top), [int(qid[j])] * len(top), rows[some[top]].tolist(), ids[some[top]].tolist(), sc[top].tolist()), strict=True):
                    o += v
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], ["query_row", "query_id", "row", "vec_id", "score"])

    def run(batches):
        key, xs, ids, rows, codes = None, [], [], [], []
        block = None
        for b in batches:
            g, salt, side = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(g):
                continue
            cuts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1]) | (side[1:] != side[:-1])))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(g)], strict=True):
                if (g[a], salt[a]) != key:
                    key, xs, ids, rows, codes, block = (g[a], salt[a]), [], [], [], [], None
                part = b.slice(a, z - a)
                x = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(z - a, -1)
                c = [np.asarray(v) for v in part.column(3).to_pylist()]
                i, r = part.column(4).to_numpy(), part.column(6).to_numpy()
                if side[a] == 0:
                    n = np.array([len(v) for v in c])
                    xs.append(np.repeat(x, n, 0))
                    ids.append(np.repeat(i, n))
                    rows.append(np.repeat(r, n))
                    codes.append(np.concatenate(c))
                elif xs:
                    if block is None:
                        block = np.concatenate(xs), np.concatenate(ids), np.concatenate(rows), np.concatenate(codes)
                    yield score(*block, x, i, r, c)

    return run


def search(df: DataFrame, queries: Column, k: int = 20, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product that probing finds for each query row.

    Every valid row is indexed in TABLES tables; a query visits the fitted number of cells in each.
    Cells are hashed into groups, and a group of over BLOCK index rows (many copies of a vector) is
    salted into blocks, to each of which its queries go: candidates are scored there with the
    original vectors in double precision, k rows a query and block go on, and a last ranking by
    query merges them. A query whose cells hold fewer than k rows is taken again against all
    blocks, so it gets k rows too, or all there are. Rows with null, zero or non-finite vectors,
    a null id, or another length than most take no part; ties go to the smaller id. Repeated rows
    are candidates, and queries, of their own. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows, d, norm, n = _vectors(df, ident, vector)
    index = build(rows, d, norm, n, k)
    kind = "g int, codes array<long>, id long, x array<double>, row long"
    data = cut(rows.mapInArrow(_place(index, False), kind), "index")
    blocks = cut(data.groupBy("g").agg(F.ceil(F.sum(F.size("codes")) / BLOCK).cast("int").alias("blocks")), "blocks")  # `groups` rows at most
    sized = F.broadcast(blocks) if index.groups <= MAPPED else blocks
    data = data.join(sized, "g").select("g", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("salt"), F.lit(0).alias("side"), "codes", "id", "x", "row")

    def ranked(asked: DataFrame) -> DataFrame:
        asked = asked.join(sized, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(1).alias("side"), "codes", "id", "x", "row")
        both = data.unionByName(asked).repartition("g", "salt").sortWithinPartitions("g", "salt", "side")
        found = both.mapInArrow(_rank(k), "query_row long, query_id long, row long, vec_id long, score double")
        by = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
        return found.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")

    out = cut(ranked(rows.where(queries).mapInArrow(_place(index, True), kind)), "neighbours")
    counts = out.groupBy(F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("_n"))
    few = cut(rows.where(queries).join(counts, "row", "left").where(F.coalesce("_n", F.lit(0)) < min(k, n - 1)).select("id", "x", "row"), "few")
    if few.isEmpty():
        return out.drop("query_row")
    again = few.select(F.explode(F.sequence(F.lit(0), F.lit(index.groups - 1))).alias("g"), F.array().cast("array<long>").alias("codes"), "id", "x", "row")
    return out.join(few.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(ranked(again)).drop("query_row")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
