"""The thin queries opN_<name>: each applies one operator to its whole table and names the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import collocations, decontam, language, licenses, lm, minhash, mixing, repeats, resample, simhash, tokens, toxicity, urls
from emberline.session import table


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: fingerprints of 3-word shingles, linked at 2 bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first copy), range-sorted by position."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    first = F.when(F.size("positions") > 0, F.element_at("positions", 1))
    found = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return found.orderBy("position", "doc_id")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST(source_size AS DOUBLE) * 2 AS stop, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM sources),
weighed AS (
  SELECT *, CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(CASE k WHEN 0 THEN -0.5 WHEN 1 THEN 0 ELSE 0.5 END AS DOUBLE) AS s FROM ranked),
levels AS (
  SELECT *, stop / weight AS r,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
      - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM weighed),
targets AS (
  SELECT *, coalesce(least(stop, weight * (SELECT arg_min(lv, r) FROM levels WHERE r > lv)), stop) AS target FROM levels),
laid AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sized),
joined AS (
  SELECT doc_id, size, t.source_size, target, s, start,
    CASE WHEN start + size / CAST(2 AS DOUBLE) < target THEN 1 ELSE 0 END AS once,
    CASE WHEN start + t.source_size + size / CAST(2 AS DOUBLE) < target THEN 1 ELSE 0 END AS twice
  FROM laid JOIN targets t ON laid.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (once + twice) * size AS taken,
  CASE WHEN once = 1 THEN CASE WHEN s = 0 THEN start / target
    ELSE (sqrt((1 - s) * (1 - s) + 4 * s * (start / target)) - (1 - s)) / (2 * s) END END AS position
FROM joined
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with near_edited and near_next."""
    docs = table(spark, sf_dir, "documents")
    pairs = minhash.edited_pairs(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        minhash.as_text(F.col("packed")).alias("fingerprint"),
        minhash.as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files written."""
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity of every document and the item that it holds."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, score: the target is the documents that labels mark as of good quality."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm.score(table(spark, sf_dir, "documents"), good)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sentence_ids, licenses, license of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    known = " ".join(f"WHEN '{k}' THEN {v}" for k, v in licenses.SENTENCES.items())
    seqs = ["," + ",".join(map(str, seq)) + "," for _, seq in licenses.RULES]
    steps = ", ".join(f"replace(line{i}, '{seq}', ',,') AS line{i + 1}" for i, seq in enumerate(seqs))
    rules = ", ".join(f"CASE WHEN contains(line{i}, '{seq}') THEN {i} END" for i, seq in enumerate(seqs))
    names = ", ".join(f"'{name}'" for name, _ in licenses.RULES)
    quoted = lambda x: "'" + x.replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(1) || '").replace("\x02", "' || chr(2) || '") + "'"
    marked = "lower(coalesce(text, ''))"
    for what, by in licenses.MARKS:
        marked = f"regexp_replace({marked}, {quoted(what)}, {quoted(by)}, 'g')"
    return rf"""
WITH marked AS (SELECT doc_id, chr(10) || {marked} || chr(10) AS x FROM documents),
ids AS (SELECT doc_id, list_transform(regexp_extract_all(x, {quoted(licenses.PATTERN)}, 1), lambda s: CASE replace(s, chr(10) || chr(10), ' ') {known} END) AS k FROM marked),
lines AS (SELECT doc_id, coalesce(array_to_string(k, ','), '') AS sentence_ids, ',' || coalesce(array_to_string(k, ','), '') || ',' AS line0 FROM ids),
used AS (SELECT *, {steps} FROM lines),
met AS (SELECT doc_id, sentence_ids, list_transform(list_filter([{rules}], lambda x: x IS NOT NULL), lambda i: [{names}][i + 1]) AS m FROM used),
kept AS (SELECT doc_id, sentence_ids, list_filter(m, lambda x, i: list_position(m, x) = i) AS m FROM met)
SELECT doc_id, sentence_ids, coalesce(array_to_string(m, ','), '') AS licenses, m[1] AS license FROM kept
"""


OP5_SQL = _op5_sql()


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the target is the benchmark's texts."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first 2000 phrases."""
    return collocations.mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + k - 1 AS BIGINT)), ' ') AS phrase
  FROM worded, (VALUES (1), (2), (3), (4), (5)) sizes(k), unnest(range(1, len(w) - k + 2)) AS starts(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, a, i, array_to_string(string_split(phrase, ' ')[:i], ' ') AS before, array_to_string(string_split(phrase, ' ')[i + 1:], ' ') AS after
  FROM kept, unnest(range(1, k)) AS t(i)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.i, x.a AS l, y.a AS r, n.n, CAST(CAST(1000 AS HUGEINT) * c.a * n.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.before JOIN f y ON y.lang = c.lang AND y.phrase = c.after JOIN n ON n.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
