"""Queries of the learner, the predictor and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, learning
from . import tables as t
from .queries import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

_HISTORY = r"""h AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_brand || ' ' || ['vat', 'bank fee', 'salary', 'rent', ''][p_partkey % 5 + 1]) AS text, CASE WHEN p_size % 10 > 0 THEN p_retailprice * (p_size % 7) END AS amount,
  ['unknown', 'entry', 'invoice'][p_size % 3 + 1] AS move_type, CASE WHEN p_size % 4 = 0 THEN 'USD' ELSE 'SAR' END AS currency,
  CASE WHEN p_partkey % 11 = 0 THEN [p_size % 7, 9] ELSE [p_size % 7] END AS debit, CASE WHEN p_partkey % 13 = 0 THEN [] ELSE [(p_size + p_partkey) % 5] END AS credit, [p_size % 4] AS journal, CASE WHEN p_size % 2 = 0 THEN [p_size % 3] ELSE [] END AS tax FROM part),
w AS (SELECT id, sha256(unnest(regexp_extract_all(text, '([a-z0-9_]+)', 1))) AS h FROM h),
d AS (SELECT id, ('0x' || left(h, 8))::BIGINT % 1024 AS dim, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM w GROUP BY ALL),
v AS (SELECT id, dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS w FROM d WHERE w <> 0),
p AS (SELECT a.id AS query_id, b.id AS row_id, round(sum(a.w * b.w), 6) AS semantic FROM v a JOIN v b USING (dim) WHERE a.id % 100 = 0 AND a.id <> b.id GROUP BY ALL HAVING semantic >= 0.02 / 0.82),
f AS (SELECT *, CASE WHEN amount IS NULL THEN 'unknown' WHEN amount = 0 THEN 'zero' WHEN amount < 100 THEN 'lt_100' WHEN amount < 1000 THEN '100_999' WHEN amount < 10000 THEN '1k_9k' WHEN amount < 100000 THEN '10k_99k' ELSE 'more' END AS bucket,
  contains(text, 'vat') AS s1, contains(text, 'bank') AS s2, contains(text, 'salary') AS s3, contains(text, 'fee') OR contains(text, 'rent') AS s4 FROM h),
c AS (SELECT query_id, row_id, semantic, [CASE WHEN a.bucket <> 'unknown' AND b.bucket <> 'unknown' THEN (a.bucket = b.bucket)::INT END, CASE WHEN a.move_type <> 'unknown' AND b.move_type <> 'unknown' THEN (a.move_type = b.move_type)::INT END, (a.currency = b.currency)::INT,
  CASE WHEN a.s1 OR b.s1 THEN (a.s1 = b.s1)::INT END, CASE WHEN a.s2 OR b.s2 THEN (a.s2 = b.s2)::INT END, CASE WHEN a.s3 OR b.s3 THEN (a.s3 = b.s3)::INT END, CASE WHEN a.s4 OR b.s4 THEN (a.s4 = b.s4)::INT END] AS c
  FROM p JOIN f a ON a.id = query_id JOIN f b ON b.id = row_id),
s AS (SELECT query_id, row_id, semantic, round(list_avg(list_filter(c, lambda x: x IS NOT NULL)), 6) AS structured FROM c),
top AS (SELECT query_id, row_id, semantic, structured, round(0.82 * semantic + 0.18 * structured, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.82 * semantic + 0.18 * structured, 6) DESC, row_id)::INT AS rank FROM s WHERE round(0.82 * semantic + 0.18 * structured, 6) >= 0.2 QUALIFY rank <= 12)"""


def history(spark, d):
    """row_id, text, amount, move_type, currency and outputs of every part."""
    k, n = F.col("p_partkey"), F.col("p_size")
    word = F.element_at(F.array(*[F.lit(w) for w in ("vat", "bank fee", "salary", "rent", "")]), (k % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(w) for w in ("unknown", "entry", "invoice")]), (n % 3 + 1).cast("int"))
    none = F.array().cast("array<bigint>")
    one = {"debit": F.when(k % 11 == 0, F.array(n % 7, F.lit(9))).otherwise(F.array(n % 7)), "credit": F.when(k % 13 == 0, none).otherwise(F.array((n + k) % 5)), "journal": F.array(n % 4), "tax": F.when(n % 2 == 0, F.array(n % 3)).otherwise(none)}
    return t.table(spark, d, "part").select(
        k.alias("row_id"), F.lower(F.concat_ws(" ", "p_name", "p_brand", word)).alias("text"), F.when(n % 10 > 0, F.col("p_retailprice") * (n % 7)).alias("amount"), kind.alias("move_type"),
        F.when(n % 4 == 0, "USD").otherwise("SAR").alias("currency"), *[c.cast("array<bigint>").alias(name) for name, c in one.items()],
    )


def _asked(rows):
    return rows.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "text", "amount", "move_type", "currency")


@query("m01_examples", f"WITH {_HISTORY} SELECT query_id, row_id, semantic, structured, score, rank FROM top")
def m01_examples(spark, d):
    """The twelve entries most like every hundredth one, by words and features."""
    rows = history(spark, d)
    return learning.similar(_asked(rows), rows)


_VOTES = """l AS (SELECT query_id, score, side, list_distinct(l) AS l FROM top JOIN (SELECT id, unnest([{'side': 'debit', 'l': debit}, {'side': 'credit', 'l': credit}, {'side': 'journal', 'l': journal}, {'side': 'tax', 'l': tax}], recursive := true) FROM h) o ON o.id = row_id WHERE len(l) > 0),
u AS (SELECT query_id, side, unnest(l) AS label, score / len(l) AS w FROM l), g AS (SELECT query_id, side, sum(score) AS total FROM l GROUP BY ALL),
vote AS (SELECT query_id, side, label, round(least(1.0, sum(w) / max(total)), 6) AS vote FROM u JOIN g USING (query_id, side) GROUP BY ALL),
strength AS (SELECT query_id, max(score) AS strength FROM top GROUP BY ALL),
acct AS (SELECT n_nationkey AS id, lower(n_name || ['', ' small ring', ' rent red'][n_nationkey % 3 + 1]) AS name, n_nationkey % 9 = 4 AS deprecated FROM nation),
best AS (SELECT vote.*, strength, deprecated, list_distinct(string_split(h.text, ' ')) AS q, string_split(acct.name, ' ') AS a FROM vote JOIN strength USING (query_id) JOIN h ON h.id = query_id LEFT JOIN acct ON acct.id = label
  QUALIFY side NOT IN ('debit', 'credit') OR row_number() OVER (PARTITION BY query_id, side ORDER BY vote DESC, label) <= 10),
conf AS (SELECT query_id, side, label, vote, CASE WHEN side IN ('debit', 'credit') THEN round(least(0.995, vote * strength * 0.92 + 0.08 * coalesce(len(list_intersect([x FOR x IN q IF x <> ''], a)) / len([x FOR x IN q IF x <> '']), 0)), 4) ELSE round(vote * strength, 4) END AS confidence FROM best WHERE NOT (side IN ('debit', 'credit') AND coalesce(deprecated, false))),
cand AS (SELECT query_id, side, label, confidence, row_number() OVER (PARTITION BY query_id, side ORDER BY CASE WHEN side IN ('debit', 'credit') THEN confidence ELSE 0 END DESC, vote DESC, label)::INT AS rank FROM conf QUALIFY rank <= 5)"""


def _accounts(spark, d):
    k = F.col("n_nationkey")
    word = F.element_at(F.array(F.lit(""), F.lit(" small ring"), F.lit(" rent red")), (k % 3 + 1).cast("int"))
    return t.table(spark, d, "nation").select(k.cast("long").alias("id"), F.concat(F.col("n_name"), word).alias("name"), F.lit("").alias("code"), (k % 9 == 4).alias("deprecated"))


def _learned(spark, d):
    rows = history(spark, d)
    asked = _asked(rows)
    found = learning.similar(asked, rows).cache()  # twelve rows a query, read five times
    return asked, found, learning.candidates(found, rows.select("row_id", "debit", "credit", "journal", "tax"), _accounts(spark, d), asked)


@query("m01_candidates", f"WITH {_HISTORY}, {_VOTES} SELECT query_id, side, label, confidence, rank FROM cand")
def m01_candidates(spark, d):
    """Accounts, journals and taxes that the examples vote for."""
    return _learned(spark, d)[2]


@query(
    "m01_findings",
    f"""WITH {_HISTORY}, {_VOTES}, one AS (SELECT query_id, max(label) FILTER (side = 'debit' AND rank = 1) AS debit, max(label) FILTER (side = 'credit' AND rank = 1) AS credit, max(label) FILTER (side = 'journal' AND rank = 1) AS journal,
      max(confidence) FILTER (side <> 'tax' AND rank = 1) AS confidence, bool_or(side = 'tax') AS tax FROM cand GROUP BY query_id)
    SELECT id AS query_id, coalesce(strength, 0) AS strength, coalesce(confidence, 0) AS confidence, one.debit, one.credit, one.journal, concat_ws(',', CASE WHEN strength IS NULL THEN 'NO_HISTORICAL_EVIDENCE' END, CASE WHEN coalesce(confidence, 0) < 0.6 THEN 'LOW_LEARNED_CONFIDENCE' END,
      CASE WHEN one.debit IS NULL OR one.credit IS NULL THEN 'INCOMPLETE_DOUBLE_ENTRY_CLASSIFICATION' END, CASE WHEN one.journal IS NULL THEN 'JOURNAL_UNRESOLVED' END, CASE WHEN one.debit = one.credit THEN 'CONTRADICTORY_ACCOUNT_SIDES' END,
      CASE WHEN contains(text, 'vat') AND NOT coalesce(one.tax, false) THEN 'VAT_SIGNAL_WITHOUT_TAX_RESOLUTION' END, CASE WHEN amount IS NULL THEN 'AMOUNT_NOT_SUPPLIED' END, CASE WHEN amount = 0 THEN 'ZERO_AMOUNT' END) AS findings
    FROM h LEFT JOIN strength ON strength.query_id = id LEFT JOIN one ON one.query_id = id WHERE id % 100 = 0""",
)
def m01_findings(spark, d):
    """What a person has to look at in every hundredth entry."""
    asked, found, best = _learned(spark, d)
    return learning.findings(asked, found, best).withColumn("findings", F.array_join("findings", ","))


DIMS = 1 << 15
TASKS = (
    learning.Task("quality"), learning.Task("toxic", strategy="linear"), learning.Task("lang"), learning.Task("source", strategy="linear"),
    learning.Task("flags", multi=True, strategy="hybrid"), learning.Task("marks", multi=True, threshold=0.4),
)


def _labelled(spark, d):
    docs = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id")
    mark = {"flags": {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 500}, "marks": {"table": F.col("text").contains("|"), "code": F.col("text").contains("="), "en": F.col("lang") == "en"}}
    sets = {c: F.filter(F.array(*[F.when(holds, F.lit(name)) for name, holds in of.items()]), lambda x: x.isNotNull()) for c, of in mark.items()}
    return docs.select(F.col("doc_id").alias("row_id"), "text", "quality", "toxic", "lang", F.expr("right(source, 1)").alias("source"), *[c.alias(n) for n, c in sets.items()])


def _vectors(spark, d):
    rows = _labelled(spark, d)
    vectors = learning.ngram_lists(rows, "row_id", "text", dims=DIMS).cache()  # read five times
    return rows, vectors.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id"), vectors


@query(
    "m04_retrieval",
    r"""WITH r AS (SELECT doc_id AS id, quality, lang, [x FOR x IN [CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '=') THEN 'code' END, CASE WHEN lang = 'en' THEN 'en' END] IF x IS NOT NULL] AS marks,
      trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT id, t, regexp_extract_all(t, '([\p{L}\p{N}_]+)', 1) AS w FROM r WHERE t <> ''),
    g AS (SELECT id, unnest(list_concat(['w ' || x FOR x IN w], ['w ' || w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], ['c ' || substr(t, i, 3) FOR i IN range(1, length(t) - 1)])) AS g FROM k),
    c AS (SELECT id, ('0x' || left(md5(g), 8))::BIGINT % 32768 AS dim, count(*)::DOUBLE AS n FROM g GROUP BY ALL), v AS (SELECT id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS w FROM c),
    p AS (SELECT a.id AS query_id, b.id AS row_id, round(sum(a.w * b.w), 6) AS dot FROM v a JOIN v b USING (dim) WHERE a.id % 100 = 0 AND a.id <> b.id GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, row_id) AS rank FROM p WHERE dot >= 1e-6 QUALIFY rank <= 5),
    a AS (SELECT query_id, sum(dot) AS total FROM n GROUP BY ALL),
    l AS (SELECT query_id, dot, unnest(list_concat([{'task': 'quality', 'label': quality::VARCHAR}, {'task': 'lang', 'label': lang}], [{'task': 'marks', 'label': x} FOR x IN marks]), recursive := true) FROM n JOIN r ON r.id = row_id),
    s AS (SELECT query_id, task, label, round(sum(dot) / max(total), 6) AS score FROM l JOIN a USING (query_id) WHERE label IS NOT NULL GROUP BY ALL)
    SELECT query_id, task, label, score, CASE WHEN task = 'marks' THEN score >= 0.4 ELSE rank = 1 END AS selected, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, task ORDER BY score DESC, label)::INT AS rank FROM s) WHERE rank <= 5""",
)
def m04_retrieval(spark, d):
    """The tasks that neighbours alone decide, for every hundredth labelled document."""
    rows, asked, vectors = _vectors(spark, d)
    return learning.predict(asked, vectors, rows, [task for task in TASKS if task.strategy == "retrieval"])


@query("m04_predictor")
def m04_predictor(spark, d):
    """All six tasks, for every hundredth labelled document, from all others."""
    rows, asked, vectors = _vectors(spark, d)
    known = vectors.where("row_id % 100 <> 0")
    return learning.predict(asked, known, rows, TASKS, DIMS).withColumn("score", F.round("score", 3))


_SCORED = """d AS (SELECT doc_id, quality, toxic, lang, n_chars, CASE WHEN doc_id % 2 = 0 THEN 'validation' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id)),
p AS (SELECT doc_id, split, unnest([{'task': 'good', 'truth': quality = 1, 'score': (n_chars % 100) / 100.0}, {'task': 'toxic', 'truth': toxic = 1, 'score': (doc_id * 7 % 100) / 100.0 * (0.5 + toxic / 2.0)},
  {'task': 'en', 'truth': lang = 'en', 'score': CASE WHEN lang = 'en' THEN 0.4 ELSE 0 END + (doc_id * 13 % 60) / 100.0}], recursive := true) FROM d)"""
GRID = [k / 20 for k in range(1, 20)]
_GRID_SQL = """g AS (SELECT k / 20.0 AS threshold FROM range(1, 20) r(k)),
c AS (SELECT task, threshold::DOUBLE AS threshold, count(*) FILTER (truth AND score >= threshold) AS tp, count(*) FILTER (NOT truth AND score >= threshold) AS fp, count(*) FILTER (truth AND score < threshold) AS fn FROM (SELECT task, truth, round(score, 6) AS score FROM p WHERE split = 'validation'), g GROUP BY ALL),
m AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c)"""


def _scored(spark, d):
    """doc_id, split, task, truth and score of three labels of every labelled document."""
    docs = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id")
    k = F.col("doc_id")
    of = {
        "good": (F.col("quality") == 1, (F.col("n_chars") % 100) / 100),
        "toxic": (F.col("toxic") == 1, (k * 7 % 100) / 100 * (0.5 + F.col("toxic") / 2)),
        "en": (F.col("lang") == "en", F.when(F.col("lang") == "en", 0.4).otherwise(0.0) + (k * 13 % 60) / 100),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("task"), truth.alias("truth"), F.round(score, 6).alias("score")) for n, (truth, score) in of.items()]))
    return docs.select("doc_id", F.when(k % 2 == 0, "validation").otherwise("test").alias("split"), each.alias("x")).select("doc_id", "split", "x.*")


@query("m05_threshold_grid", f"WITH {_SCORED}, {_GRID_SQL} SELECT task, threshold, tp, fp, fn, precision, recall, f1 FROM m")
def m05(spark, d):
    """Nineteen thresholds of three labels on the validation half, from one count."""
    return evaluate.threshold_grid(_scored(spark, d).where("split = 'validation'"), GRID)


@query(
    "m06_locked_evaluation",
    f"""WITH {_SCORED}, {_GRID_SQL}, b AS (SELECT task, threshold FROM m QUALIFY row_number() OVER (PARTITION BY task ORDER BY f1 DESC, threshold) = 1),
    s AS (SELECT doc_id, split, list(task) FILTER (truth) AS t, list(task) FILTER (round(score, 6) >= threshold) AS g, list(task ORDER BY score DESC, task)[1:2] AS top FROM p JOIN b USING (task) GROUP BY ALL),
    n AS (SELECT split, coalesce(len(t), 0) AS a, coalesce(len(g), 0) AS b, coalesce(len(list_intersect(t, g)), 0) AS both_, coalesce(len(list_intersect(t, top)), 0) AS hit FROM s)
    SELECT split, count(*) AS n, round(2 * sum(both_) / sum(a + b), 6) AS micro_f1, round(avg(CASE WHEN a + b > 0 THEN 2 * both_ / (a + b) ELSE 0 END), 6) AS samples_f1, round(sum(a + b - 2 * both_) / (count(*) * 3), 6) AS hamming_loss,
      round(avg((both_ = a AND both_ = b)::INT), 6) AS exact_match, round(avg(CASE WHEN a > 0 THEN hit / a END), 6) AS recall_at_k FROM n GROUP BY split""",
)
def m06(spark, d):
    """The thresholds that are best on the validation half, and what they are worth on both halves."""
    scored = _scored(spark, d)
    chosen = evaluate.best_thresholds(evaluate.threshold_grid(scored.where("split = 'validation'"), GRID)).select("task", "threshold")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "task")))
    sets = scored.join(chosen, "task").groupBy("doc_id", "split").agg(F.collect_list(F.when(F.col("truth"), F.col("task"))).alias("truth"), F.collect_list(F.when(F.col("score") >= F.col("threshold"), F.col("task"))).alias("guess"), F.transform(listed, lambda x: x["task"]).alias("ranked"))
    out = [evaluate.multi_metrics(sets.where(F.col("split") == s), 3, ranked="ranked", k=2).withColumn("split", F.lit(s)) for s in ("validation", "test")]
    return out[0].unionByName(out[1])


@query(
    "m06_joint_match",
    f"""WITH {_SCORED}, j AS (SELECT doc_id, split, bool_and(truth = (round(score, 6) >= 0.5)) AS ok FROM p GROUP BY ALL), v AS (SELECT split, count(*) AS n, round(avg(ok::INT), 6) AS m FROM j GROUP BY split)
    SELECT max(m) FILTER (split = 'validation') AS validation, max(m) FILTER (split = 'test') AS test, round(max(m) FILTER (split = 'validation') - max(m) FILTER (split = 'test'), 6) AS gap FROM v""",
)
def m06_joint(spark, d):
    """The share of documents with all three labels right at .5 in either half, and the gap between them."""
    wide = _scored(spark, d).withColumn("guess", F.col("score") >= 0.5).groupBy("doc_id", "split").pivot("task", ["good", "toxic", "en"]).agg(F.first("truth").alias("truth"), F.first("guess").alias("guess"))
    joint = evaluate.joint_exact_match(wide, {x: (f"{x}_truth", f"{x}_guess") for x in ("good", "toxic", "en")})
    return evaluate.gaps(joint.withColumn("_all", F.lit(1)), ["_all"], "joint_exact_match").drop("_all")
