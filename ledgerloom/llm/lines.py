"""Line deduplication by a segment-partition edit join.

A line is redundant if an earlier line of the corpus (smaller id, or the same document and further up) equals it or is within
``edits`` edits. Equal lines collapse to their first place before anything is joined. Two lines within k edits agree on one of
k + 1 segments: every distinct line is indexed under the hashes of its segments, with its length, and probes the indexes of its
own and of up to k smaller lengths at the few places where a segment can then lie. Pairs that meet are verified by a banded
bit-parallel edit distance. Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SMALL_ENDS = 1_000_000  # lines of candidate pairs up to which their hashes (16 bytes each) are broadcast; beyond it the join shuffles


@dataclass(frozen=True)
class LineRules:
    """``edits``: 1 to 20. A line with a word that equals an earlier one goes, however short it is; one of ``least_chars`` code points or more also if it is within ``edits`` of
    an earlier one of as many. Every later line goes, however much of its document that is."""

    edits: int = 1
    least_chars: int = 20


def segment(length: str, i: int, edits: int) -> tuple[str, str]:
    """SQL for start (from 0) and size of segment ``i`` (from 0) of lines of ``length`` code points."""
    base, early = f"({length} DIV {edits + 1})", f"({edits + 1} - {length} % {edits + 1})"
    return f"({i} * {base} + greatest(0, {i} - {early}))", f"({base} + IF({i} >= {early}, 1, 0))"


def keys(edits: int) -> Column:
    """The index keys (role 0) and probe keys (role 1) of a column ``line`` with ``len`` code points, as an array of structs."""
    out = []
    for i in range(edits + 1):
        start, size = segment("len", i, edits)
        out.append(f"struct(xxhash64(len, {i}, substring(line, {start} + 1, {size})) AS key, 0 AS role)")
    for less in range(edits + 1):
        own = f"(len - {less})"
        for i in range(edits + 1):
            start, size = segment(own, i, edits)
            # Places at which segment i + 1 can lie, if the segments before and after it hold the rest of the edits.
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                if less or shift:
                    out.append(f"struct(IF({start} + {shift} BETWEEN 0 AND len - {size}, xxhash64({own}, {i}, substring(line, {start} + {shift} + 1, {size})), NULL) AS key, 1 AS role)")
    return F.expr(f"array({', '.join(out)})")


def within(a: str, b: str, edits: int) -> Column:
    """Whether the strings in columns ``a`` and ``b`` are within ``edits``: a banded bit-parallel dynamic program.

    Bit k of the words stands for row j - edits + k of column j. The sum of the lowest row in the band is carried down the
    diagonal, then along the last row.
    """
    k, width = edits, 2 * edits + 1
    mask = (1 << width) - 1
    hit = " + ".join(f"IF(coalesce(get(_x, j - {k} + {i} - 1) = get(_y, j - 1), false), {1 << i}L, 0L)" for i in range(width))
    d0 = f"((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {mask}L"
    hp, hn = f"((s.vn | ~(d | s.vp)) & {mask}L)", "(d & s.vp)"
    bit = f"shiftleft(1L, CAST(m - j + {k} AS INT))"
    dist = f"""IF(j <= m - {k}, s.dist + IF((d & {1 << (width - 1)}L) = 0, 1, 0),
                   s.dist + IF(({hp} & {bit}) != 0, 1, 0) - IF(({hn} & {bit}) != 0, 1, 0))"""
    new = f"""named_struct('vp', ({hn} | ~(shiftright(d, 1) | {hp})) & {mask}L, 'vn', shiftright(d, 1) & {hp}, 'dist', {dist})"""
    step = f"transform(array({hit}), pm -> transform(array({d0}), d -> {new})[0])[0]"
    start = f"named_struct('vp', {((1 << (k + 1)) - 1) << k}L, 'vn', 0L, 'dist', {k})"
    run = f"aggregate(sequence(1, size(_y)), {start}, (s, j) -> {step}, s -> s.dist <= {k})".replace("m - j", "size(_x) - j").replace("m - " + str(k), f"size(_x) - {k}")
    whole = f"CASE WHEN abs(length({a}) - length({b})) > {k} THEN false WHEN least(length({a}), length({b})) <= {k} THEN levenshtein({a}, {b}) <= {k} ELSE RUN END"
    return F.expr(whole.replace("RUN", f"transform(array(named_struct('x', split({a}, ''), 'y', split({b}, ''))), p -> {run.replace('_x', 'p.x').replace('_y', 'p.y')})[0]"))


BAG = "eanitros"  # letters whose counts, modulo 64, are compared before two lines are


def bag(line: str) -> Column:
    """The counts of eight letters in one long, six bits each."""
    parts = [f"shiftleft(CAST((length({line}) - length(replace({line}, '{c}', ''))) % 64 AS BIGINT), {6 * k})" for k, c in enumerate(BAG)]
    return F.expr(" | ".join(parts))


def bags_within(a: str, b: str, edits: int) -> Column:
    """Whether two bags may belong to lines within ``edits``: an edit changes two counts by one at most."""
    out = F.lit(0)
    for k in range(len(BAG)):
        x, y = (F.shiftright(F.col(c), 6 * k).bitwiseAND(63) for c in (a, b))
        out = out + F.least(F.pmod(x - y, F.lit(64)), F.pmod(y - x, F.lit(64)))
    return out <= 2 * edits


def row_key(id_col: str, text_col: str) -> Column:
    """The id and a hash of the text, which tells rows of one id, and rows without one, apart. Rows equal in both are one document read twice."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"))


def lines_of(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """``row_key`` as id, line number (from 0), line, its length and 128 bits of hash, for lines with a word and enough code points."""
    line = docs.select(row_key(id_col, text_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("no", "line"))
    line = line.withColumn("len", F.length("line")).where(f"len >= {max(1, least_chars)}").where(F.expr(r"btrim(line, ' \t\n\u000B\u000C\r') != ''"))
    return line.select("id", "no", "line", "len", F.xxhash64(F.lit(1), "line").alias("h"), F.xxhash64(F.lit(2), "line").alias("g"), bag("line").alias("bag"))


def near_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs (h, g, h2, g2) of different lines within ``edits``, from ``lines_of`` rows; each pair once, smaller hashes first."""
    each = lines.select("h", "g", "bag", F.explode(keys(edits)).alias("_k")).select("h", "g", "bag", "_k.key", "_k.role").where("key IS NOT NULL")
    # A key under which one line alone stands makes no pair. Equal lines meet in the tasks that read them.
    met = each.groupBy("key").agg(F.min("h").alias("_a"), F.max("h").alias("_b"), F.min("role").alias("_r")).where("_a != _b AND _r = 0").select("key")
    some = cut(each.join(met, "key", "left_semi").distinct())
    left = some.where("role = 0").select("key", "h", "g", "bag")
    right = some.select("key", F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("bag").alias("bag2"))
    pairs = left.join(right, "key").where("h != h2 OR g != g2").where(bags_within("bag", "bag2", edits))
    low, high = F.struct("h", "g"), F.struct(F.col("h2").alias("h"), F.col("g2").alias("g"))
    pairs = pairs.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")).distinct()
    pairs = cut(pairs.select("a.h", "a.g", F.col("b.h").alias("h2"), F.col("b.g").alias("g2")))
    ends = cut(pairs.select("h", "g").union(pairs.select("h2", "g2")).distinct())
    ends = F.broadcast(ends) if ends.count() <= SMALL_ENDS else ends
    text = cut(lines.select("h", "g", "line").join(ends, ["h", "g"], "left_semi").dropDuplicates(["h", "g"]))
    two = pairs.join(text, ["h", "g"]).join(text.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("line").alias("line2")), ["h2", "g2"])
    return two.where(within("line", "line2", edits)).select("h", "g", "h2", "g2")


def kept_places(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (a ``row_key``) and the line numbers ``nos`` that are the first of their kind and have no earlier line within ``edits``."""
    lines = lines_of(docs, 1, id_col, text_col)
    place = F.struct("id", "no")
    first = cut(lines.groupBy("h", "g").agg(F.min(place).alias("at")))
    pairs = near_pairs(lines.where(F.col("len") >= rules.least_chars), rules.edits)
    a = first.select("h", "g", F.col("at").alias("at1"))
    b = first.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("at").alias("at2"))
    later = pairs.join(a, ["h", "g"]).join(b, ["h2", "g2"]).select(F.greatest("at1", "at2").alias("at")).distinct()
    kept = first.select("at").join(later, "at", "left_anti")
    return kept.select("at.*").groupBy("id").agg(F.collect_list("no").alias("nos"))


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """The rows of ``docs`` with redundant lines taken out of ``text_col``; with ``counts`` also ``n_lines`` and ``n_removed``.

    All rows and other columns stay. A null text stays null. Lines go by id (null first), then a hash of the text, then line number: rows that share an id are told apart by their
    texts, and rows equal in both are one document read twice, which keeps the same lines in each.
    """
    nos = kept_places(docs, rules, id_col, text_col).withColumnsRenamed({"id": "_id", "nos": "_nos"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key(id_col, text_col).alias("_key"))
    rows = rows.join(nos, F.col("_key") == F.col("_id"), "left").drop("_id", "_key")
    body = F.coalesce(F.col("_row")[text_col], F.lit(""))
    rows = rows.withColumn("_lines", F.split(body, "\n"))
    rows = rows.withColumn("_flags", F.expr("transform(_lines, (x, i) -> length(x) >= 1 AND btrim(x, ' \\t\\n\\u000B\\u000C\\r') != '')"))
    rows = rows.withColumn("_bad", F.expr("array_except(filter(transform(_flags, (f, i) -> IF(f, i, -1)), i -> i >= 0), coalesce(_nos, array()))"))
    # Both lists ascend: the kept lines are the runs between the removed ones.
    runs = "transform(sequence(0, size(_bad)), k -> slice(_lines, IF(k = 0, 0, _bad[k - 1] + 1) + 1, IF(k = size(_bad), size(_lines), _bad[k]) - IF(k = 0, 0, _bad[k - 1] + 1)))"
    text = F.when(F.col("_row")[text_col].isNull() | (F.size("_bad") == 0), F.col("_row")[text_col]).otherwise(F.expr(f"array_join(flatten({runs}), '\\n')"))
    out = [F.col("_row")[c].alias(c) if c != text_col else text.alias(c) for c in docs.columns]
    if counts:
        out += [F.expr("CAST(size(filter(_flags, f -> f)) AS BIGINT)").alias("n_lines"), F.size("_bad").cast("long").alias("n_removed")]
    return rows.select(*out)
