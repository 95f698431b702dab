"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification, components.

Equal shingle sets collapse to their smallest id before anything is paired. Sets that agree on a band of their signatures are
candidates. In each bucket, members are first compared with one representative. Buckets that then still hold different components
are joined to families and compared in blocks of bounded size, each block by arrays: first the likeliest partners of each member,
then every pair that is left. A candidate's signatures are compared in batches: it goes as soon as the posterior probability that
its similarity reaches the threshold falls below ``miss``. What survives is verified in its block on the full sets of both texts,
so only links leave a block. Pairs inside one component need no test: a large group of copies costs a comparison per member, and
no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, lower_ascii, mix, partitions, shared_path, texts, word_hashes, words

SMALL_IDS = 1_000_000  # candidate ids, or families, up to which they are broadcast (8 or 16 bytes each); beyond it the join shuffles


@dataclass(frozen=True)
class Near:
    """``width``: words of a shingle; linked if 100 * intersection >= ``percent`` * union. ``bands`` of ``rows`` hashes each."""

    width: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    batch: int = 24
    miss: float = 1e-6
    chunk: int = 256  # members of a family on either side of a block
    chunk_shingles: int = 1 << 20  # and their shingles, but for a larger text
    best: int = 2  # partners of a member in the first pass over the blocks


def chained(hashed: np.ndarray, width: int) -> np.ndarray:
    """One hash of each ``width`` hashes in a row; every step is a bijection of the last hash, for a given one before."""
    n = max(len(hashed) - width + 1, 0)
    out = mix(hashed[:n] + np.uint64(width))
    for k in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : n + k])
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Sorted distinct hashes of the shingles of each text of a run; texts of fewer words have one shingle, texts without words none."""
    for run in texts(column):
        begin, end, first = words(run)
        hashed = word_hashes(lower_ascii(run.data), begin, end)
        shingles, out = chained(hashed, width), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            out.append(np.unique(shingles[a : b - width + 1]) if b - a >= width else chained(hashed[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        yield run.rows, out


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` minima for each of the sets, none of which is empty."""
    flat = mix(np.concatenate(sets))
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), n), np.uint64)
    for k, m in enumerate(multipliers(n)):
        out[:, k] = np.minimum.reduceat(flat * m, starts)
    return out


def least_matches(how: Near) -> list[tuple[int, int]]:
    """(n, m): after n one-byte hashes, a pair with fewer than m matches is pruned. Uniform prior over the similarity."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    total = how.bands * how.rows
    out = []
    for n in range(how.batch, total + 1, how.batch):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
            mass = np.exp(log - log.max())
            if mass[j >= how.percent / 100].sum() >= how.miss * mass.sum():
                out.append((n, m))
                break
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"))


def fingerprint(docs: DataFrame, how: Near, id_col: str, text_col: str) -> DataFrame:
    """id, x (hash of the text), n (set size), s and t (128 bits that name the set), bands (array of hashes) and sig (one byte of each minimum)."""
    total = how.bands * how.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, sets in shingle_sets(b.column(2), how.width):
                full = [k for k, s in enumerate(sets) if len(s)]
                names = np.zeros((len(sets), 2), np.uint64)
                bands: list[np.ndarray | None] = [None] * len(sets)
                sig: list[bytes | None] = [None] * len(sets)
                if full:
                    some = [sets[k] for k in full]
                    least = signatures(some, total)
                    starts = np.cumsum([0, *map(len, some)])[:-1]
                    flat = np.concatenate(some)
                    names[full, 0] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    names[full, 1] = np.add.reduceat(mix(flat * np.uint64(0x9E3779B97F4A7C15)), starts)
                    keys = least.reshape(len(full), how.bands, how.rows)
                    key = np.full((len(full), how.bands), 1, np.uint64) * (np.arange(how.bands, dtype=np.uint64) + np.uint64(1))
                    for r in range(how.rows):
                        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + keys[:, :, r])
                    short = (least >> np.uint64(40)).astype(np.uint8)
                    for i, k in enumerate(full):
                        bands[k], sig[k] = key[i].view(np.int64), short[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(rows.start, len(sets)) for c in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(names[:, c].view(np.int64)) for c in (0, 1)), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["id", "x", "n", "s", "t", "bands", "sig"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, x long, n long, s long, t long, bands array<long>, sig binary")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) for every id in ``links`` (a, b): least labels of neighbours, then of labels, until none changes."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("_n"))
        step = label.join(near, F.col("id") == F.col("a")).select("id", F.col("comp").alias("_old"), F.least("comp", "_n").alias("_c"))
        jump = step.select(F.col("id").alias("_i"), F.col("_c").alias("_j"))
        new = cut(step.join(jump, F.col("_c") == F.col("_i"), "left").select("id", "_old", F.coalesce("_j", "_c").alias("comp")))
        changed = new.where("comp != _old").limit(1).count()
        label = new.select("id", "comp")
        if not changed:
            return label


def _likely(pairs: DataFrame, sigs: DataFrame, how: Near) -> DataFrame:
    """``pairs`` (a, b) that the sequential test leaves."""
    bounds = least_matches(how)
    two = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("_x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("_y")), "b").select("a", "b", "_x", "_y")
    total = how.bands * how.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, total) for c in (batch.column(2), batch.column(3)))
            left, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, m in bounds:
                matches[left] += (x[left, done:n] == y[left, done:n]).sum(1)
                left, done = left[matches[left] >= m], n
            yield batch.select(["a", "b"]).take(pa.array(left))

    return two.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, body: DataFrame, how: Near) -> DataFrame:
    """``pairs`` (a, b) whose full sets are similar enough; ``body``: id, text."""
    two = pairs.join(body.select(F.col("id").alias("a"), F.col("text").alias("_x")), "a").join(body.select(F.col("id").alias("b"), F.col("text").alias("_y")), "b").select("a", "b", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            b, ys = batch.column(1).to_pylist(), batch.column(3)
            for rows, sets in shingle_sets(batch.column(2), how.width):
                for i, x in zip(range(rows.start, rows.stop), sets):
                    if b[i] != last:  # rows come in the order of b
                        last, last_set = b[i], next(shingle_sets(ys.slice(i, 1), how.width))[1][0]
                    same = len(np.intersect1d(x, last_set, assume_unique=True))
                    if same and 100 * same >= how.percent * (len(x) + len(last_set) - same):
                        keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return two.mapInArrow(run, "a long, b long")


def _blocks(rest: DataFrame, sigs: DataFrame, how: Near) -> DataFrame:
    """``rest`` (key, id, comp, top, outside) dealt to blocks: family, p, q, left, id, comp, n, sig.

    A family is all open buckets whose largest component is the same one. Its members outside of that component, and the others,
    are cut into chunks of bounded rows and shingles; a block pairs a chunk of the first with a later one or with one of the others.
    """
    rows = rest.select(F.col("top").alias("family"), "id", "comp", "outside").distinct().join(sigs, "id")

    def chunks(of: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(of) / how.chunk), F.ceil(F.sum(F.when(of, F.col("n")).otherwise(0)) / how.chunk_shingles)).cast("int")

    size = rows.groupBy("family").agg(chunks(F.col("outside")).alias("_no"), chunks(~F.col("outside")).alias("_nt"))
    size = cut(size)
    rows = rows.join(F.broadcast(size) if size.count() <= SMALL_IDS else size, "family")
    rows = rows.withColumn("_c", F.pmod(F.xxhash64(F.lit(5), "id"), F.when(F.col("outside"), F.col("_no")).otherwise(F.col("_nt"))).cast("int"))
    as_left = F.when(F.col("outside"), F.expr("transform(sequence(_c, _no + _nt - 1), q -> struct(_c AS p, q AS q, true AS left))")).otherwise(F.expr("slice(array(struct(0 AS p, 0 AS q, true AS left)), 1, 0)"))
    as_right = F.when(F.col("outside"), F.expr("transform(sequence(0, _c), p -> struct(p AS p, _c AS q, false AS left))")).otherwise(F.expr("transform(sequence(0, _no - 1), p -> struct(p AS p, _no + _c AS q, false AS left))"))
    return rows.withColumn("_b", F.explode(F.concat(as_left, as_right))).select("family", "_b.p", "_b.q", "_b.left", "id", "comp", "n", "sig")


def _survivors(left: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, bounds: list[tuple[int, int]], how: Near, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block in different components whose sizes allow a link and that the sequential test (``bounds``) leaves, likeliest first for each left row."""
    (first, least), *more = bounds
    l, r = np.flatnonzero(left), np.flatnonzero(~left)
    matches = np.zeros((len(l), len(r)), np.int16)
    for k in range(first):
        matches += sig[l, k][:, None] == sig[r, k][None, :]
    i, j = np.nonzero((matches >= least) & (comp[l][:, None] != comp[r][None, :]))
    found, done = matches[i, j].astype(np.int64), first
    i, j = l[i], r[j]
    ok = 100 * np.minimum(n[i], n[j]) >= how.percent * np.maximum(n[i], n[j])
    i, j, found = i[ok], j[ok], found[ok]
    for upto, least in more:
        found += (sig[i, done:upto] == sig[j, done:upto]).sum(1)
        ok = found >= least
        i, j, found, done = i[ok], j[ok], found[ok], upto
    order = np.lexsort((j, -found, i))
    i, j = i[order], j[order]
    if every or not len(i):
        return i, j
    start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
    return i[rank < how.best], j[rank < how.best]


def _links_of(i: np.ndarray, j: np.ndarray, comp: np.ndarray, sets: dict[int, np.ndarray], how: Near) -> list[tuple[int, int]]:
    """Of the pairs (i, j), links that join components: a pair whose ends have met by then is not tested."""
    root, out = comp.copy(), []
    edges = [*np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])).tolist(), len(i)]
    for x, y in zip(edges[:-1], edges[1:]):
        one = int(i[x])
        own = sets[one]
        for at in range(x, y, 64):
            others = j[at : min(at + 64, y)]
            others = others[root[others] != root[one]]
            if not len(others):
                continue
            there = [sets[k] for k in others.tolist()]
            sizes = np.array([len(t) for t in there])
            flat = np.concatenate(there)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            same = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            for k in others[100 * same >= how.percent * (len(own) + sizes - same)].tolist():
                if root[k] != root[one]:
                    out.append((one, k))
                    root[root == root[k]] = root[one]
    return out


def _block_links(rest: DataFrame, sigs: DataFrame, body: DataFrame, how: Near, every: bool) -> DataFrame:
    """a, b: links between different components, tested and verified block by block; a block gives fewer links than it has rows.

    ``every``: all pairs of the blocks count, else each row's likeliest partners in a block.
    """
    total, bounds = how.bands * how.rows, least_matches(how)
    dealt = _written(_blocks(rest, sigs, how), "near-blocks")
    # Up to sixteen blocks a task: a task's Python worker costs more than a small block.
    blocks = dealt.agg(F.approx_count_distinct(F.struct("family", "p", "q"))).first()[0]
    least = partitions(rest.sparkSession)
    number = max(least, min(4 * least, -(-blocks // 16)))

    def pairs(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        comp, n = (np.asarray(block.column(c), np.int64) for c in ("comp", "n"))
        sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8).reshape(-1, total)
        return comp, *_survivors(block.column("left").to_numpy().astype(bool), comp, n, sig, bounds, how, every)

    def used(block: pa.Table) -> pa.RecordBatch | None:
        _, i, j = pairs(block)
        if not len(i):
            return None
        return block.select(["family", "p", "q", "id"]).take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()[0]

    def solve(block: pa.Table) -> pa.RecordBatch | None:
        comp, i, j = pairs(block)
        if not len(i):
            return None
        ids = np.asarray(block.column("id"), np.int64)
        some = np.unique(np.concatenate([i, j]))
        sets = dict(zip(some.tolist(), (s for _, part in shingle_sets(block.column("text").take(pa.array(some)), how.width) for s in part)))
        found = np.array(_links_of(i, j, comp, sets, how), np.int64).reshape(-1, 2)
        a, b = ids[found[:, 0]], ids[found[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    # Only members that the signatures leave fetch their texts. A block's work grows with its pairs, not its bytes, so a number of
    # partitions is given: else small ones would be joined.
    def by_block(rows: DataFrame, of, schema: str) -> DataFrame:
        return rows.repartition(number, "family", "p", "q").sortWithinPartitions("family", "p", "q", "left", "id").mapInArrow(_each_block(of), schema)

    likely = cut(by_block(dealt, used, "family long, p int, q int, id long"))
    rows = dealt.join(likely, ["family", "p", "q", "id"], "left_semi").join(body, "id").select("family", "p", "q", "left", "id", "comp", "n", "sig", "text")
    return by_block(rows, solve, "a long, b long").distinct()


def _each_block(of: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of`` over the blocks of a partition that is sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept
            family, p, q = (np.asarray(kept.column(c), np.int64) for c in ("family", "p", "q"))
            edges = [0, *(np.flatnonzero((family[1:] != family[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist(), *([len(family)] if last else [])]
            for x, y in zip(edges[:-1], edges[1:]):
                got = of(kept.slice(x, y - x))
                if got is not None:
                    yield got
            kept = kept.slice(edges[-1])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            yield from blocks(False)
        if kept is not None and kept.num_rows:
            yield from blocks(True)

    return run


def near_components(docs: DataFrame, how: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_shingles, component_id (smallest id reachable by links, itself included), kept (it is that id).

    Null and wordless texts have empty sets, linked with nothing. Rows with a null id take no part: component null, kept true.
    Rows that share an id are one document, each has a row; if their texts differ, one of them (the least by a hash of its set)
    stands for the id where links are looked for, and a row whose set equals another document's joins that one's component too.
    Ids have to be whole numbers.
    """
    spark = docs.sparkSession
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} has to hold whole numbers")
    prints = _written(fingerprint(docs, how, id_col, text_col), "near-prints")
    parts = prints.where("n > 0 AND id IS NOT NULL")
    sets = cut(parts.groupBy("s", "t").agg(F.min("id").alias("rep")))
    first = parts.join(sets.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi")
    first = first.groupBy("id").agg(F.min(F.struct("s", "t", "x", "n", "bands", "sig")).alias("_r")).select("id", "_r.x", "_r.n", "_r.bands", "_r.sig")
    every = first.select("id", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1")
    buckets = _written(every.join(shared, "key").select("key", "id", "least"), "near-buckets")
    ids = cut(buckets.select("id").distinct())
    few = ids.count() <= SMALL_IDS
    some = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    sigs = _written(first.select("id", "x", "n", "sig").join(some(ids), "id", "left_semi"), "near-sigs")
    body = _texts(docs, id_col, text_col).join(some(sigs.select("id", "x")), ["id", "x"], "left_semi").select("id", "text")
    body = _written(body.dropDuplicates(["id"]), "near-texts")
    sigs = sigs.drop("x")
    tested = cut(buckets.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())
    links = cut(_linked(_likely(tested, sigs, how), body, how))
    label = components(links)
    for every in (False, True):
        named = buckets.join(label, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        parts_of = named.groupBy("key", "comp").agg(F.count("*").alias("m"))
        open_ = parts_of.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("m", "comp")).alias("top")).where("k > 1")
        rest = _written(named.join(open_.select("key", F.col("top.comp").alias("top")), "key").withColumn("outside", F.col("comp") != F.col("top")), "near-open")
        if rest.isEmpty():
            break
        found = cut(_block_links(rest, sigs, body, how, every))
        if not found.isEmpty():
            links = links.union(found)
            label = components(links)
    named = prints.select("id", "n", "s", "t").join(sets.select("s", "t", "rep"), ["s", "t"], "left")
    named = named.join(label.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("comp", "rep", "id")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNotNull(), own)
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, how: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that are not the smallest id of their component."""
    gone = near_components(docs, how, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return by_key(docs, id_col).join(gone, F.col("_key").cast("long") == F.col("_gone"), "left_anti").select("_row.*")
