"""Text search by an inverted index of grams: which rows hold a term anywhere in a field, without comparing every term with every text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import name_match as nm
from .staged import staged

WIDTH, LONG = 3, 6


@dataclass(frozen=True)
class Limits:
    """What a search returns at most: newest hits of each field, rows in all; and the terms that a query is expanded to."""

    field: int = 1200
    total: int = 5000
    terms: int = 8


def _substrings(text: Column, width: int) -> Column:
    places = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(width))))


def grams(text: Column) -> Column:
    """Distinct grams of three and of six characters of a text; one of less than three is its only gram."""
    return F.when(F.length(text) < WIDTH, F.array(text)).otherwise(F.concat(_substrings(text, WIDTH), _substrings(text, LONG)))


def asked_grams(term: Column) -> Column:
    """The grams that a term of three characters or more is found by: long ones, which are much rarer, if it has any."""
    return F.when(F.length(term) < LONG, _substrings(term, WIDTH)).otherwise(_substrings(term, LONG))


class TextIndex:
    """Texts (id, field, text in lower case), postings (gram, text_key) of each distinct text, and how many postings a gram has.

    Rows of one id are one row; null and empty texts are in no list. ``text_key`` is a hash: texts that share one are all looked at. Postings grow with the distinct texts, about two
    rows a character, and are read by the grams asked for only: kept as a table (``write``) they are sorted by gram, so that Parquet statistics pass over most of a file. Spark takes
    postings for as small as the table they come from, so that each join with them says that it is not to be a broadcast.
    """

    def __init__(self, texts: DataFrame, postings: DataFrame | None = None, sizes: DataFrame | None = None):
        self.texts = texts
        self.postings = texts.select(F.xxhash64("text").alias("text_key"), "text").distinct().select(F.explode(grams(F.col("text"))).alias("gram"), "text_key") if postings is None else postings
        self.sizes = self.postings.groupBy("gram").agg(F.count("*").alias("n")) if sizes is None else sizes

    @classmethod
    def of(cls, rows: DataFrame, id_col: str, fields: list[str]) -> TextIndex:
        """An index over ``fields``, numbered in their order."""
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.lower(F.col(c)).alias("text")) for k, c in enumerate(fields)]))
        return cls(rows.select(F.col(id_col).alias("id"), each.alias("x")).select("id", "x.field", "x.text").where("text <> ''"))

    def write(self, path: str, files: int = 64) -> TextIndex:
        """The index as Parquet under ``path``, postings in ranges of grams."""
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")
        stored = type(self).read(self.texts.sparkSession, path, texts_only=True)
        stored.postings.repartitionByRange(files, "gram").sortWithinPartitions("gram", "text_key").write.mode("overwrite").parquet(f"{path}/postings")
        self.texts.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
        return type(self).read(self.texts.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, texts_only: bool = False) -> TextIndex:
        texts = spark.read.parquet(f"{path}/texts")
        return cls(texts) if texts_only else cls(texts, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"))

    def _probes(self, terms: DataFrame, most: int) -> DataFrame:
        """term, gram, need: the rarest grams of a term of three characters or more, all of which a hit has; for a shorter one every gram that holds it, one of which a hit has.

        A term with a gram that the index does not know has no probe.
        """
        long = terms.where(F.length("term") >= WIDTH).select("term", asked_grams(F.col("term")).alias("g"))
        long = long.select("term", F.size("g").alias("whole"), F.explode("g").alias("gram")).join(self.sizes.hint("merge"), "gram")
        of = Window.partitionBy("term")
        long = long.withColumn("known", F.count("*").over(of)).withColumn("r", F.row_number().over(of.orderBy("n", "gram"))).where(f"known = whole AND r <= {most}")
        long = long.select("term", "gram", F.least(F.lit(most), "whole").cast("long").alias("need"))
        known = self.sizes.where(F.length("gram") <= WIDTH).select("gram", F.explode(F.array_distinct(F.concat(F.array("gram"), *[_substrings(F.col("gram"), w) for w in range(1, WIDTH)]))).alias("term"))
        short = terms.where(F.length("term") < WIDTH).join(known.hint("merge"), "term").select("term", "gram", F.lit(1).cast("long").alias("need"))
        return long.unionByName(short)

    def find(self, terms: DataFrame, most: int = 1) -> DataFrame:
        """term, id and field of every field that holds the term (both in lower case). ``terms`` has the column ``term``; null and empty ones are in no text.

        Postings of each term's ``most`` rarest grams are intersected, then what is left is checked against its text.
        """
        return self.hits(terms, most).drop("text")

    def hits(self, terms: DataFrame, most: int = 1) -> DataFrame:
        """``find`` with the texts."""
        asked = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
        met = self._probes(asked, most).join(self.postings.hint("merge"), "gram").groupBy("term", "text_key").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need")
        keyed = self.texts.select("id", "field", "text", F.xxhash64("text").alias("text_key"))
        return met.hint("merge").join(keyed, "text_key").where(F.col("text").contains(F.col("term"))).select("term", "id", "field", "text")


def search(index: TextIndex, terms: DataFrame, order: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """query_id, id, field, term: for every query the rows that hold one of its terms, each once.

    ``terms`` has query_id and term; the first eight of a query count by ``rank`` if that column is there, else by term. Of each field the newest rows stay (by the columns of ``order``
    after its id, descending, then by id), then those of the first fields up to the limit in all. A row met by several fields or terms shows the one whose term covers most of its
    field, ties to the first field, then the least term.
    """
    rank = F.col("rank") if "rank" in terms.columns else F.lower("term")
    mine = terms.select("query_id", F.lower("term").alias("term"), rank.alias("_rank")).where("term <> ''")
    mine = mine.groupBy("query_id", "term").agg(F.min("_rank").alias("_rank"))
    mine = mine.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("_rank", "term"))).where(F.col("_r") <= limits.terms).select("query_id", "term")
    by = [] if order is None else [c for c in order.columns if c != "id"]
    hits = index.hits(mine) if order is None else index.hits(mine).join(order, "id")
    # The newest rows of all terms of a query are among the newest of each: terms are cut before queries, which may share them, get their rows.
    newest = Window.partitionBy("term", "field").orderBy(*[F.desc(c) for c in [*by, "id"]])
    hits = hits.distinct().withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limits.field).drop("_n")
    return narrowed(mine.join(hits.hint("merge"), "term"), by, limits)


def narrowed(hits: DataFrame, by: list[str], limits: Limits) -> DataFrame:
    """query_id, id, field, term of ``hits`` (with text and the columns ``by``) after the limits."""
    newest = [F.desc(c) for c in [*by, "id"]]
    covers = F.length("term") / F.length("text")
    one = hits.groupBy("query_id", "field", "id", *by).agg(F.min(F.struct((-covers).alias("covers"), "term")).alias("best"))
    one = one.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "field").orderBy(*newest))).where(F.col("_n") <= limits.field)
    rows = one.groupBy("query_id", "id", *by).agg(F.min("field").alias("_first"), F.min(F.struct(F.col("best.covers").alias("covers"), "field", F.col("best.term").alias("term"))).alias("best"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("_first", *newest))).where(F.col("_n") <= limits.total)
    return rows.select("query_id", "id", F.col("best.field").alias("field"), F.col("best.term").alias("term"))


def expanded(queries: DataFrame, matched: DataFrame, model: nm.Model, limits: Limits = Limits()) -> DataFrame:
    """query_id, term, rank: a query's name, its Latin spelling, and the words and texts of the partners it matched that match it themselves.

    ``queries`` has query_id and name, ``matched`` query_id, name, partner_id and partner.
    """
    word = F.explode(F.filter(F.regexp_extract_all("partner", F.lit("([A-Za-z؀-ۿ][A-Za-z؀-ۿ-]{2,})"), 1), lambda w: w != ""))
    words = matched.select("query_id", "name", "partner_id", word.alias("term")).distinct()
    words = nm.score_pairs(words, "name", "term", model).where("decision = 'match'").select("query_id", "term", F.concat_ws(" ", F.lpad(F.col("partner_id").cast("string"), 19, "0"), F.lit("0")).alias("rank"))
    whole = matched.select("query_id", F.col("partner").alias("term"), F.concat_ws(" ", F.lpad(F.col("partner_id").cast("string"), 19, "0"), F.lit("1")).alias("rank"))
    own = queries.select("query_id", F.col("name").alias("term"), F.lit("-0").alias("rank")).unionByName(queries.select("query_id", nm.latin_of("name").alias("term"), F.lit("-1").alias("rank")))
    every = own.unionByName(words).unionByName(whole).withColumn("term", F.trim(F.regexp_replace("term", r"\s+", " "))).where(F.length("term") >= 2)
    every = every.groupBy("query_id", F.lower("term").alias("term")).agg(F.min("rank").alias("rank"))
    return every.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "term"))).where(F.col("_r") <= limits.terms).drop("_r")


def global_search(queries: DataFrame, partners: DataFrame, lines: DataFrame, fields: list[str], model: nm.Model, limits: Limits = Limits()) -> DataFrame:
    """query_id, id, field, text, score, reason: ledger lines that have to do with a name, by partner or by text, whose best field matches it.

    ``queries``: query_id, name. ``partners``: partner_id, partner. ``lines``: id, date, partner_id and the texts of ``fields``. Partners that match give their lines and the terms of
    the search; each line is one row with the field that is most like the name (ties: the first field). Matches, terms and lines are staged: each feeds several steps, and their
    plans within each other were hundreds of stages, too large for a driver.
    """
    matched = nm.match_names(queries, partners, "query_id", "name", "partner_id", "partner", model).where("decision = 'match'")
    matched = staged(matched.select("query_id", "name", "partner_id", "partner"))
    terms = staged(expanded(queries, matched, model, limits))
    index = TextIndex.of(lines, "id", fields)
    newest = Window.partitionBy("query_id").orderBy(F.desc("date"), F.desc("id"))
    theirs = lines.select("id", "date", "partner_id").join(matched.select("query_id", "partner_id"), "partner_id").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limits.field)
    found = search(index, terms, lines.select("id", "date"), limits)
    ids = theirs.select("query_id", "id", "date", F.lit(0).alias("_by")).unionByName(found.join(lines.select("id", "date"), "id").select("query_id", "id", "date", F.lit(1).alias("_by")))
    ids = ids.groupBy("query_id", "id", "date").agg(F.min("_by").alias("_by"))
    ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("_by", F.desc("date"), F.desc("id")))).where(F.col("_n") <= limits.total)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("field"), F.col(c).alias("text")) for k, c in enumerate(fields)]))
    texts = ids.select("query_id", "id").join(lines, "id").select("query_id", "id", each.alias("x")).select("query_id", "id", "x.*").where("text <> ''")
    judged = nm.score_pairs(staged(texts.join(queries.select("query_id", "name"), "query_id")), "name", "text", model)
    best = judged.groupBy("query_id", "id").agg(F.max(F.struct("score", (-F.col("k")).alias("k"), "field", "text", "decision", "reason")).alias("b"))
    return best.where("b.decision = 'match'").select("query_id", "id", "b.field", "b.text", "b.score", "b.reason")
