"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Every document gets whole-number measures. A sketch of a measure is a table of counts by bin: a bin keeps the six leading
binary digits of its values, so a quantile is off by 1/32 at most, sketches merge by adding counts, and a task sends one row
per group and bin. Fences per language and source come from the sketches' quartiles; groups with few documents use the merged
sketch of their language, or of everything. Documents outside their group's fences are rejected. Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut

SYMBOLS = "#*$%&|<>"
SMALL_GROUPS = 10_000  # groups up to which their thresholds are broadcast (under 1 MB); beyond it the join shuffles
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rules:
    """A fence stands ``spread`` times the range between the first and the last of ``parts`` equal shares of a group's documents beyond that share's end.
    A range is not known finer than the sketch's bins: it counts as a sixteenth of its upper end at least, and as 1.

    ``measures`` have fences, those in ``two_sided`` a lower one too. ``least_docs``: documents that a group's own sketch needs. ``least_words`` and ``most_repeat_percent`` are the base rules.
    """

    spread: int = 6
    parts: int = 10
    least_docs: int = 200
    least_words: int = 10
    most_repeat_percent: int = 20
    measures: tuple[str, ...] = ("symbol_rate", "upper_rate", "mean_length")
    two_sided: tuple[str, ...] = ("mean_length",)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``extra``, and the counts of each document; a null text counts as empty.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier one),
    n_repeat_words (words in five-word windows found twice or more in the text), n_upper (A-Z).
    """
    text = f"coalesce(`{text_col}`, '')"
    ws = r"\t\n\u000B\u000C\r"
    keep = [f"`{c}`" for c in (id_col, *extra)]
    step = docs.selectExpr(
        *keep,
        f"filter(split(translate({text}, '{ws}', '     '), ' '), x -> x != '') AS _w",
        f"filter(split({text}, '\\n'), x -> btrim(x, ' {ws}') != '') AS _l",
        f"length(translate({text}, ' {ws}', '')) AS word_chars",
        f"length({text}) - length(translate({text}, '{SYMBOLS}', '')) AS n_symbols",
        f"length({text}) - length(translate({text}, '{UPPER}', '')) AS n_upper",
    )
    counts = ["CAST(word_chars AS BIGINT) AS word_chars", "CAST(n_symbols AS BIGINT) AS n_symbols", "CAST(n_upper AS BIGINT) AS n_upper"]
    step = step.selectExpr(*keep, *counts, "CAST(size(_w) AS BIGINT) AS n_words", "CAST(size(_l) - size(array_distinct(_l)) AS BIGINT) AS n_dup_lines", "transform(_w, x -> xxhash64(x)) AS _h")
    kept = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper"]
    step = step.selectExpr(*kept, "CASE WHEN n_words > 5 THEN transform(sequence(0, CAST(n_words AS INT) - 5), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4])) ELSE array(0L) END AS _g")
    # Only texts in which a window repeats need the windows sorted with their places.
    step = step.selectExpr(*kept, "CASE WHEN size(array_distinct(_g)) < size(_g) THEN sort_array(transform(_g, (x, i) -> struct(x AS h, i AS i))) ELSE slice(array(struct(0L AS h, 0 AS i)), 1, 0) END AS _s")
    step = step.selectExpr(*kept, "filter(_s, (x, k) -> (k > 0 AND x.h = get(_s, k - 1).h) OR (k < size(_s) - 1 AND x.h = get(_s, k + 1).h)) AS _r")
    step = step.selectExpr(*kept, "sort_array(transform(_r, x -> x.i)) AS _p")
    repeat = "aggregate(_p, struct(0L AS total, -5 AS last), (a, p) -> struct(a.total + least(5, p - a.last) AS total, p AS last), a -> a.total)"
    return step.selectExpr(*kept, f"{repeat} AS n_repeat_words")


def rates() -> dict[str, Column]:
    """The measures that have thresholds, as whole numbers; null where there are no words."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    chars = F.when(F.col("word_chars") > 0, F.col("word_chars"))
    return {
        "symbol_rate": F.floor(10000 * F.col("n_symbols") / words).cast("long"),
        "upper_rate": F.floor(10000 * F.col("n_upper") / chars).cast("long"),
        "mean_length": F.floor(1000 * F.col("word_chars") / words).cast("long"),
    }


def bin_of(value: Column) -> Column:
    """The least whole number with the same six leading binary digits and as many digits."""
    cut_off = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    power = F.pow(F.lit(2.0), cut_off).cast("long")
    return value - value % power


def sketch(measures: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Mergeable sketches: ``groups``, measure, bin, n. Rows without the measure take no part."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in names]))
    rows = measures.select(*groups, each.alias("_m")).select(*groups, "_m.measure", bin_of(F.col("_m.value")).alias("bin")).where("bin IS NOT NULL")
    return rows.groupBy(*groups, "measure", "bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of larger groups, from those of smaller ones."""
    return sketches.groupBy(*groups, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, groups: list[str], parts: int = 4) -> DataFrame:
    """``groups``, measure, n, q1 and q3: the least bins up to which one share of ``parts`` of the values lies, and all but one share (a quarter and three quarters)."""
    from pyspark.sql import Window

    keys = [*groups, "measure"]
    by_bin = Window.partitionBy(*keys)
    run = sketches.withColumn("_upto", F.sum("n").over(by_bin.orderBy("bin"))).withColumn("_all", F.sum("n").over(by_bin))
    return run.groupBy(*keys).agg(
        F.max("_all").alias("n"),
        F.min(F.when(F.col("_upto") * parts >= F.col("_all"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("_upto") * parts >= F.col("_all") * (parts - 1), F.col("bin"))).alias("q3"),
    )


def thresholds(measures: DataFrame, rules: Rules = Rules(), lang: str = "_lang", source: str = "_source") -> DataFrame:
    """One row for each language and source: ``low_m`` and ``high_m`` for each measure m (null: no fence)."""
    names = list(rules.measures)
    own = cut(sketch(measures, [lang, source], names))
    levels = [("own", [lang, source]), ("by_lang", [lang]), ("by_all", [])]
    table = own.select(lang, source).distinct()
    for level, groups in levels:
        q = quartiles(merge(own, groups) if len(groups) < 2 else own, groups, rules.parts)
        wide = q.groupBy(*groups).agg(*[F.max(F.when(F.col("measure") == m, F.struct("n", "q1", "q3"))).alias(f"{level}_{m}") for m in names])
        table = table.join(wide, groups, "left") if groups else table.crossJoin(wide)  # one row
    out = []
    for m in names:
        enough = [F.when(F.col(f"{level}_{m}.n") >= rules.least_docs, F.col(f"{level}_{m}")) for level, _ in levels]
        q = F.coalesce(*enough, F.col(f"by_all_{m}"))
        reach = rules.spread * F.greatest(q["q3"] - q["q1"], F.shiftright(q["q3"], 4), F.lit(1))
        low = q["q1"] - reach if m in rules.two_sided else F.lit(None).cast("long")
        out += [low.alias(f"low_{m}"), (q["q3"] + reach).alias(f"high_{m}")]
    return table.select(lang, source, *out)


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each input row: id, the counts, base_failed and kept.

    Null languages and sources are groups of their own. A document without words fails the base rules; rows that share an id are
    judged one by one. Windows of words are equal if 64-bit hashes of their words' 64-bit hashes are. Measures are made once
    and kept in the shared folder, without texts; the thresholds join them by language and source.
    """
    table = docs.withColumns({"_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit(""))})
    # Thresholds see what the counts below see, so the counts are made once.
    found = cut(measure(table, id_col, text_col, ("_lang", "_source"))).withColumns(rates())
    limits = thresholds(found, rules)
    words = F.col("n_words")
    failed = (words < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * words)
    outside = F.lit(False)
    for m in rules.measures:
        outside = outside | F.coalesce(F.col(m) < F.col(f"low_{m}"), F.lit(False)) | F.coalesce(F.col(m) > F.col(f"high_{m}"), F.lit(False))
    groups = cut(limits)  # a row for each language and source
    joined = found.join(F.broadcast(groups) if groups.count() <= SMALL_GROUPS else groups, ["_lang", "_source"], "left")
    return joined.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~outside).alias("kept"))


def keep_good(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, whose ids pass. Rows that share an id stay or go together: all have to pass."""
    bad = judge(docs, rules, id_col, text_col, lang_col, source_col).where(~F.col("kept")).select(F.col(id_col).alias("_id")).distinct()
    return by_key(docs, id_col).join(bad, F.col("_key").eqNullSafe(F.col("_id")), "left_anti").select("_row.*")
