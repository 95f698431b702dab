"""The registered queries of the training-data operators: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, leaks, lines, mixing, near, periods, quality, substrings, suffixes, topk, turns, unigram
from .common import read_table

try:
    import public_tokenizers

    BPE_FILE, UNIGRAM_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
except ModuleNotFoundError:
    BPE_FILE, UNIGRAM_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
    RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words in windows of 35 that also start elsewhere go."""
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"), window=35)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: bytes in strings of 100 that also start earlier go."""
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"), window=100)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every whole text."""
    return ctw.score(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_unknown, score: best pieces of every whole text, by the scores of a BPE file.

    No unigram file is installed, and tokenizers are not trained here. These scores are negative merge ranks, not log probabilities: counts are not those of that
    file's own encoder.
    """
    return unigram.count_tokens(read_table(spark, sf_dir, "documents"), UNIGRAM_FILE)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), BPE_FILE, ids=False, digests=True)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: two-word shingles, similarity of 0.8 or more."""
    return near.near_components(read_table(spark, sf_dir, "documents"), near.Near(width=2))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every whole text."""
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (that take part), n_removed, kept_sha256 of the text that is left; no document is exempt."""
    left = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


_OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents
), t AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS part FROM l
), f AS (
  SELECT line, length(line) AS n, min((doc_id, no)) AS pos FROM t WHERE part GROUP BY line
), long AS (
  SELECT * FROM f WHERE n >= 20
), half AS (
  SELECT line, n AS m, pos, 0 AS side, left(line, n // 2) AS piece FROM long
  UNION ALL SELECT line, n, pos, 1, right(line, n - n // 2) FROM long
), probe AS (
  SELECT line, n AS m, pos, 0 AS side, left(line, n // 2) AS piece FROM long
  UNION ALL SELECT line, n, pos, 1, right(line, n - n // 2) FROM long
  UNION ALL SELECT line, n - 1, pos, 0, left(line, (n - 1) // 2) FROM long
  UNION ALL SELECT line, n - 1, pos, 1, right(line, n - 1 - (n - 1) // 2) FROM long
), later AS (
  SELECT DISTINCT greatest(a.pos, b.pos) AS pos
  FROM half a JOIN probe b ON a.m = b.m AND a.side = b.side AND a.piece = b.piece AND a.line <> b.line WHERE levenshtein(a.line, b.line) <= 1
), k AS (
  SELECT pos FROM f WHERE pos NOT IN (SELECT pos FROM later)
), flagged AS (
  SELECT t.*, part AND NOT EXISTS (SELECT 1 FROM k WHERE k.pos = (t.doc_id, t.no)) AS bad FROM t
)
SELECT doc_id, count(*) FILTER (part) AS n_lines, count(*) FILTER (bad) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT bad), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

MIX_WEIGHTS = {"domain": {"web": 2, "books": 3, "other": 1}, "lang": {"en": 4, "de": 3, "fr": 2, "es": 2}, "source": {"src0": 3, "src1": 2}}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies: how often every document is taken for a budget of half the tokens, up to two epochs."""
    decided, _ = mixing.plan(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, part_percent=50, epochs=2, seed=7)
    return decided.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "n_tokens", "copies")


def _op9_sql() -> str:
    def weight(level: str, column: str) -> str:
        return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items()) + " ELSE 1 END"

    def level(name: str, parent: str, given: str, node: str, path: str) -> str:
        over = f"PARTITION BY {parent} ORDER BY capacity::DECIMAL(38, 12) / weight, name"
        on = f" JOIN {given} USING ({path})" if path else f", {given}"
        cols = f"{path}, {node}" if path else node
        return f"""
{name}_n AS (SELECT {cols}, {node} AS name, capacity, {weight(name, node)} AS weight, given AS g
  FROM (SELECT {cols}, sum(capacity) AS capacity FROM leaf GROUP BY {cols}){on}),
{name}_o AS (SELECT *, g - coalesce(sum(capacity) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w, row_number() OVER ({over}) AS k FROM {name}_n),
{name}_f AS (SELECT *, capacity * w <= l * weight AS f FROM {name}_o),
{name} AS (SELECT {cols}, (CASE WHEN f THEN capacity ELSE greatest(first_l * weight // first_w, 0) END)::BIGINT AS given
  FROM (SELECT *, first_value(l) OVER v AS first_l, first_value(w) OVER v AS first_w FROM {name}_f
    WINDOW v AS (PARTITION BY {parent} ORDER BY f, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""

    return (
        r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len([x FOR x IN string_split_regex(coalesce(text, ''), '[ 	-
]+') IF x <> ''])::BIGINT AS n_tokens,
  md5(concat('7:', doc_id)) AS o FROM documents),
t AS (SELECT *, CASE WHEN NOT regexp_matches(source, '[0-9]$') THEN 'other' WHEN regexp_matches(source, '[02468]$') THEN 'web' ELSE 'books' END AS domain FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS capacity FROM t GROUP BY ALL),
root AS (SELECT least(sum(capacity), sum(tokens) * 50 // 100)::BIGINT AS given FROM leaf),"""
        + ",".join([level("domain", "1", "root", "domain", ""), level("lang", "domain", "domain", "lang", "domain"), level("source", "domain, lang", "lang", "source", "domain, lang")])
        + """,
b AS (SELECT domain, lang, source, tokens, given, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole FROM leaf JOIN source USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens,
  (whole + CASE WHEN given - whole * tokens > 0 AND upto <= given - whole * tokens THEN 1 ELSE 0 END)::BIGINT AS copies
FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM t) JOIN b USING (domain, lang, source)"""
    )


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of all rows for every vec_id divisible by 20."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x::DOUBLE[], d.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


_OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, lang, source, t,
         [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM d
), u AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM s
), g AS (
  SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g,
         lead(i, 4) OVER o IS NOT NULL AS whole
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE whole) WHERE n > 1
), c AS (
  SELECT doc_id, sum(k) AS n_repeat_words
  FROM (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS k FROM r) GROUP BY doc_id
), m AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM s LEFT JOIN c USING (doc_id)
), v AS (
  SELECT doc_id, lang, source, 'symbol_rate' AS measure, CASE WHEN n_words > 0 THEN 10000 * n_symbols // n_words END AS value, false AS two FROM m
  UNION ALL SELECT doc_id, lang, source, 'upper_rate', CASE WHEN word_chars > 0 THEN 10000 * n_upper // word_chars END, false FROM m
  UNION ALL SELECT doc_id, lang, source, 'mean_length', CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words END, true FROM m
), b AS (
  SELECT lang, source, measure,
         value - value % (1::BIGINT << greatest(length(bin(value)) - 6, 0)) AS bin FROM v WHERE value IS NOT NULL
), levels AS (
  SELECT 1 AS level, lang AS gl, source AS gs, measure, bin, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 2, lang, NULL, measure, bin, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, measure, bin, count(*) FROM b GROUP BY ALL
), upto AS (
  SELECT *, sum(n) OVER (PARTITION BY level, gl, gs, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, gl, gs, measure) AS total FROM levels
), q AS (
  SELECT level, gl, gs, measure, max(total) AS n, min(bin) FILTER (upto * 10 >= total) AS q1, min(bin) FILTER (upto * 10 >= total * 9) AS q3
  FROM upto GROUP BY ALL
), f AS (
  SELECT v.doc_id,
         bool_or(coalesce(v.value > coalesce(o.q3, l.q3, a.q3) + 6 * greatest(coalesce(o.q3, l.q3, a.q3) - coalesce(o.q1, l.q1, a.q1), coalesce(o.q3, l.q3, a.q3) // 16, 1), false)
              OR coalesce(v.two AND v.value < coalesce(o.q1, l.q1, a.q1) - 6 * greatest(coalesce(o.q3, l.q3, a.q3) - coalesce(o.q1, l.q1, a.q1), coalesce(o.q3, l.q3, a.q3) // 16, 1), false)) AS outside
  FROM v
  LEFT JOIN q o ON o.level = 1 AND o.gl = v.lang AND o.gs = v.source AND o.measure = v.measure AND o.n >= 200
  LEFT JOIN q l ON l.level = 2 AND l.gl = v.lang AND l.measure = v.measure AND l.n >= 200
  LEFT JOIN q a ON a.level = 3 AND a.measure = v.measure
  GROUP BY v.doc_id
), e AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT outside AS kept
FROM e JOIN f USING (doc_id)
"""

def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the strongest run, runs_sha256, collapsed_sha256: words that repeat with a period, in texts of which a tenth got repeating tails."""
    return periods.digest(periods.find_runs(periods.with_tails(read_table(spark, sf_dir, "documents"))))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage."""
    return turns.digest(turns.repair(turns.damaged(read_table(spark, sf_dir, "conversations")), live=F.col("_live")))


def _op12_sql() -> str:
    """States are ten digits of cost and then the audit, so that text order is their order."""

    def plus(state: str, cost: str | int, letter: str) -> str:
        return f"lpad((left({state}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({state}, 11) || {letter}"

    user = f"least(u, {plus('n', 3, "'I'")}, {plus('s', 3, "'I'")}, {plus('a', 3, "'I'")})"
    more = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"

    def becomes(initial: str, source: str) -> str:
        same = f"initial = '{initial}'"
        return f"CASE WHEN fault IN (0, 3) THEN {plus(source, f'{more} + CASE WHEN {same} THEN 0 ELSE 3 END', f"CASE WHEN {same} THEN 'K' ELSE 'R' END")} END"

    gone = {k: plus(k, 4, "'D'") for k in "nsua"}
    closed = f"SELECT c, i, n, s, u, least(a, {plus('u', 3, "'I'")}) AS a FROM (SELECT c, i, n, s, {user} AS u, a FROM {{}})"
    return rf"""
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
), k AS (
  SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
           lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, table_of
), d AS (
  SELECT c, t, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k
), g AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY t NULLS FIRST) AS seen FROM d
), f AS (
  SELECT c, t, role, text, left(role, 1) AS initial, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM g WINDOW w AS (PARTITION BY c ORDER BY t NULLS FIRST, role, text, seen)
), step AS (
  SELECT DISTINCT c, 0::BIGINT AS i, '0000000000' AS n, '1000000000' AS s, '1000000000' AS u, '1000000000' AS a FROM k
  UNION ALL
  SELECT x.c, x.i + 1, {gone['n']}, least({gone['s']}, CASE WHEN fault IN (0, 3) AND initial = 's' THEN {plus('n', more, "'K'")} END),
         least({gone['u']}, {becomes('u', 'least(n, s, a)')}), least({gone['a']}, {becomes('a', 'u')})
  FROM ({closed.format('step')}) x JOIN f ON f.c IS NOT DISTINCT FROM x.c AND f.i = x.i + 1
), last AS (
  SELECT c, left(best, 10)::BIGINT AS cost, substr(best, 11) AS audit FROM (SELECT c, i, least(n, a) AS best FROM ({closed.format('step')})) QUALIFY i = max(i) OVER (PARTITION BY c)
), letters AS (
  SELECT c, j, substr(audit, j, 1) AS letter, j - length(replace(left(audit, j), 'I', '')) AS inserted, length(replace(left(audit, j), 'D', '')) AS o
  FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS j FROM last)
), lines AS (
  SELECT l.c, j, letter, o, f.role, f.text, coalesce(bool_or(o = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY l.c), false)::INT AS led
  FROM letters l LEFT JOIN f ON f.c IS NOT DISTINCT FROM l.c AND f.i = l.j - l.inserted
), repaired AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body
  FROM lines WHERE letter <> 'D' GROUP BY c
), counts AS (
  SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c
)
SELECT last.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM last LEFT JOIN counts ON counts.c IS NOT DISTINCT FROM last.c LEFT JOIN repaired ON repaired.c IS NOT DISTINCT FROM last.c
"""


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: secrets by pattern, and strings that a tokenizer's vocabulary finds random."""
    return leaks.digest(leaks.find_secrets(read_table(spark, sf_dir, "documents"), RANKS_FILE))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_suffix_dedup": op2_suffix_dedup, "op3_lm_score": op3_lm_score, "op4_token_counts": op4_token_counts, "op5_bpe": op5_bpe, "op6_near_dedup": op6_near_dedup, "op7_quality_rules": op7_quality_rules, "op8_line_dedup": op8_line_dedup, "op9_mixing": op9_mixing, "op10_top_k": op10_top_k, "op11_periodic_runs": op11_periodic_runs, "op12_turn_repair": op12_turn_repair, "op13_secret_scan": op13_secret_scan}
ORACLES: dict[str, str] = {"op7_quality_rules": _OP7_SQL, "op8_line_dedup": _OP8_SQL, "op9_mixing": _op9_sql(), "op10_top_k": _OP10_SQL, "op12_turn_repair": _op12_sql()}
