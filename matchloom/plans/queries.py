"""The engine's queries over the tables at hand, and independent SQL for each that has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import keys as K
from matchloom.functions.features import EDIT_FEATURES, TOKEN_FEATURES, edit_features, finite_rows, levenshtein_similarity, linear_weights, logistic_score, pair_text, token_features, with_features
from matchloom.functions.text import normalize, prepare, source_of
from matchloom.operators import audit, blocking, evaluate, model, sampling, tfidf, validate
from matchloom.plans import adapter
from matchloom.sources import readers, sinks
from matchloom.sources.readers import bad_ids, id_list
from matchloom.sources.staging import stage, work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
THRESHOLD, K_BEST = 0.5, 5
#: Weights of the folded logistic score that queries use: an example, not a fitted model.
WEIGHTS, INTERCEPT = (2.5, 1.5, 1.0, 0.75, 0.5, -0.5, 0.25, 0.5, 0.25, -0.25), -3.0

_TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
_CLEAN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_JACCARD = "(len(list_intersect({0}, {1})) / greatest(1, len(list_distinct(list_concat({0}, {1})))))"
_DOCS = f"""b AS (SELECT doc_id, coalesce(lang, '') AS country, {_CLEAN.format("text")} AS body FROM documents),
bw AS (SELECT *, list_transform(list_sort(list_transform({_TOK.format("body")}, lambda t: lpad(abs(length(t) - 5)::VARCHAR, 8, '0') || t)), lambda x: substr(x, 9)) AS w FROM b),
rec AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, 'S' || (doc_id % 3 + 1) AS source, array_to_string(w[1:4], ' ') AS name, array_to_string(w[5:12], ' ') AS address, country, body FROM bw)"""
_PARTIES = f"""rec AS (SELECT 'S1-' || c_custkey AS entity_id, 'S1' AS source, {_CLEAN.format("c_name")} AS name, {_CLEAN.format("n_name || ' ' || n_nationkey")} AS address, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'S2-' || s_suppkey, 'S2', {_CLEAN.format("s_name")}, {_CLEAN.format("n_name || ' ' || n_nationkey")}, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_KEYS = f""",
nw AS (SELECT entity_id, source, unnest({_TOK.format("name")}) AS t FROM rec),
aw AS (SELECT entity_id, source, unnest({_TOK.format("address")}) AS t FROM rec),
ndf AS (SELECT t, count(*) AS df FROM nw WHERE source = 'S1' GROUP BY t),
adf AS (SELECT t, count(*) AS df FROM aw WHERE source = 'S1' GROUP BY t),
rn AS (SELECT entity_id, t, row_number() OVER (PARTITION BY entity_id ORDER BY df, t) AS r FROM nw JOIN ndf USING (t) WHERE source = 'S1' AND length(t) > 2),
ra AS (SELECT entity_id, t, row_number() OVER (PARTITION BY entity_id ORDER BY df, t) AS r FROM aw JOIN adf USING (t) WHERE source = 'S1' AND length(t) >= 3 AND NOT regexp_full_match(t, '\\p{{Nd}}+')),
num AS (SELECT entity_id, t, row_number() OVER (PARTITION BY entity_id ORDER BY t) AS r FROM aw WHERE regexp_full_match(t, '\\p{{Nd}}+')),
lw AS (SELECT entity_id, t, row_number() OVER (PARTITION BY entity_id ORDER BY length(t) DESC, t) AS r FROM aw WHERE length(t) >= 5 AND NOT regexp_matches(t, '\\p{{Nd}}')),
qk AS (SELECT entity_id, 'n' || chr(1) || name AS key FROM rec WHERE source = 'S1'
 UNION SELECT x.entity_id, 'p' || chr(1) || least(x.t, y.t) || chr(1) || greatest(x.t, y.t) FROM rn x JOIN rn y ON x.entity_id = y.entity_id AND x.r = 1 AND y.r = 2
 UNION SELECT x.entity_id, 'a' || chr(1) || x.t || chr(1) || s.t FROM rn x JOIN (SELECT entity_id, t FROM num WHERE r <= 3 UNION SELECT entity_id, t FROM lw WHERE r <= 2) s ON s.entity_id = x.entity_id AND x.r = 1),
aqk AS (SELECT entity_id, 'z' || chr(1) || address AS key FROM rec WHERE source = 'S1' AND address <> ''
 UNION SELECT x.entity_id, 'w' || chr(1) || least(x.t, y.t) || chr(1) || greatest(x.t, y.t) FROM ra x JOIN ra y ON x.entity_id = y.entity_id AND x.r = 1 AND y.r = 2
 UNION SELECT x.entity_id, 'd' || chr(1) || x.t || chr(1) || n.t FROM ra x JOIN num n ON n.entity_id = x.entity_id AND x.r = 1 AND n.r <= 3),
tkk AS (SELECT entity_id, 'n' || chr(1) || name AS key FROM rec WHERE source <> 'S1'
 UNION SELECT x.entity_id, 'p' || chr(1) || x.t || chr(1) || y.t FROM nw x JOIN nw y ON x.entity_id = y.entity_id AND x.t < y.t WHERE x.source <> 'S1' AND length(x.t) > 2 AND length(y.t) > 2
 UNION SELECT x.entity_id, 'a' || chr(1) || x.t || chr(1) || s.t FROM nw x JOIN (SELECT entity_id, t FROM num UNION SELECT entity_id, t FROM lw) s ON s.entity_id = x.entity_id WHERE x.source <> 'S1' AND length(x.t) > 2),
aw3 AS (SELECT entity_id, t FROM aw WHERE source <> 'S1' AND length(t) >= 3 AND NOT regexp_full_match(t, '\\p{{Nd}}+')),
atk AS (SELECT entity_id, 'z' || chr(1) || address AS key FROM rec WHERE source <> 'S1' AND address <> ''
 UNION SELECT x.entity_id, 'w' || chr(1) || x.t || chr(1) || y.t FROM aw3 x JOIN aw3 y ON x.entity_id = y.entity_id AND x.t < y.t
 UNION SELECT x.entity_id, 'd' || chr(1) || x.t || chr(1) || n.t FROM aw3 x JOIN num n ON n.entity_id = x.entity_id)"""
_PAIRS = f""",
allq AS (SELECT * FROM qk UNION SELECT * FROM aqk),
capq AS (SELECT * FROM allq WHERE key IN (SELECT key FROM allq GROUP BY key HAVING count(*) <= 10)),
pr AS (SELECT DISTINCT q.entity_id AS s1_id, t.entity_id AS target_id FROM capq q JOIN (SELECT * FROM tkk UNION SELECT * FROM atk) t USING (key)),
f AS (SELECT s1_id, target_id, q.name, q.address, q.country, t.name AS target_name, t.address AS target_address, t.country AS target_country, t.source AS target_source,
 {_TOK.format("q.name")} AS qn, {_TOK.format("t.name")} AS tn, {_TOK.format("q.address")} AS qa, {_TOK.format("t.address")} AS ta FROM pr JOIN rec q ON q.entity_id = s1_id JOIN rec t ON t.entity_id = target_id),
j AS (SELECT *, {_JACCARD.format("qn", "tn")} AS nj, {_JACCARD.format("qa", "ta")} AS aj FROM f),
sc AS (SELECT *, greatest(0.65::DOUBLE * nj + 0.30::DOUBLE * aj + 0.05::DOUBLE * (name = target_name)::INT, 0.85::DOUBLE * aj + 0.15::DOUBLE * nj) AS blocking_score FROM j),
tk AS (SELECT *, row_number() OVER (PARTITION BY s1_id, target_source ORDER BY blocking_score DESC, target_id DESC)::INT AS blocking_rank FROM sc),
sp AS (SELECT entity_id AS s1_id, country FROM rec WHERE source = 'S1'),
tr AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id FROM rec a JOIN rec b ON a.name = b.name WHERE a.source = 'S1' AND b.source <> 'S1' AND a.name <> ''
 AND len(list_intersect({_TOK.format("a.address")}, {_TOK.format("b.address")})) * 2 >= greatest(1, len(list_distinct(list_concat({_TOK.format("a.address")}, {_TOK.format("b.address")})))))"""
_CAND, _CANDP = f"WITH {_DOCS}{_KEYS}{_PAIRS}", f"WITH {_PARTIES}{_KEYS}{_PAIRS}"
_F = "CASE WHEN n_true = 0 THEN (n_predicted = 0)::INT::DOUBLE ELSE 1.25::DOUBLE * hits / (0.25::DOUBLE * n_true + n_predicted) END"
_METRICS = f"""round(avg({_F}), 9) AS macro_f05, CASE WHEN sum(n_predicted) > 0 THEN sum(hits) / sum(n_predicted) ELSE 0 END::DOUBLE AS precision, CASE WHEN sum(n_true) > 0 THEN sum(hits) / sum(n_true) ELSE 0 END::DOUBLE AS recall,
 round(avg(CASE WHEN n_true = 0 THEN {_F} END), 9) AS singleton_f05, round(avg(CASE WHEN n_true > 0 THEN {_F} END), 9) AS matched_f05, round(avg(CASE WHEN n_true > 1 THEN {_F} END), 9) AS multi_match_f05"""


def _counts(predicted: str, truth: str = "tr", spine: str = "sp", by: str = "") -> str:
    """Per record: true, predicted and common links. by: a column of predicted and spine, with a comma before it."""
    on = " AND ".join(f"x.{c.strip()} = {{0}}.{c.strip()}" for c in ["s1_id", *by.split(",")[1:]])
    return f"""SELECT x.s1_id{"".join(f", x.{c.strip()}" for c in by.split(",")[1:])}, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_predicted, coalesce(p.h, 0) AS hits FROM {spine} x
 LEFT JOIN (SELECT s1_id, count(*) AS n FROM {truth} GROUP BY 1) t ON t.s1_id = x.s1_id
 LEFT JOIN (SELECT y.s1_id{by}, count(*) AS n, count(z.s1_id) AS h FROM {predicted} y LEFT JOIN {truth} z ON z.s1_id = y.s1_id AND z.target_id = y.target_id GROUP BY y.s1_id{by}) p ON {on.format("p")}"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return adapter.split(adapter.documents(spark, d))


def _candidates(spark: SparkSession, d: str, k: int = K_BEST) -> DataFrame:
    return blocking.candidates(*_records(spark, d), k)


def _setting(spark: SparkSession, d: str, k: int = K_BEST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reference records, targets, spine, truth and ranked candidates."""
    s1, targets = _records(spark, d)
    return s1, targets, adapter.spine(s1), stage(adapter.truth(s1, targets)), stage(blocking.candidates(s1, targets, k))


def _rounded(rows: DataFrame, digits: int = 9) -> DataFrame:
    return rows.select(*[F.round(c, digits).alias(c) if t == "double" and c.endswith("f05") else c for c, t in rows.dtypes])


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS normalized FROM documents")
def er_normalize(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", normalize(F.col("text")).alias("normalized"))


@query(f"WITH {_PARTIES} SELECT entity_id, name AS normalized_name, address AS normalized_address, {_CLEAN.format('country')} AS normalized_country, name || ' ' || address AS retrieval_text, '[NAME] ' || name || ' [ADDRESS] ' || address || ' [COUNTRY] ' || {_CLEAN.format('country')} AS combined_text FROM rec")
def er_prepare(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.parties(spark, d).withColumnsRenamed({"name": "business_name", "address": "business_address"})
    return prepare(rows).select("entity_id", "normalized_name", "normalized_address", "normalized_country", "retrieval_text", "combined_text")


@query(f"WITH {_DOCS}{_KEYS} SELECT 'name' AS field, t AS token, df FROM ndf UNION ALL SELECT 'address', t, df FROM adf UNION ALL SELECT 'body', t, count(*) FROM (SELECT unnest({_TOK.format('body')}) AS t FROM rec WHERE source = 'S1') GROUP BY t")
def er_token_df(spark: SparkSession, d: str) -> DataFrame:
    s1, _ = _records(spark, d)
    parts = [blocking.document_frequency(s1, c).select(F.lit(c).alias("field"), "token", "df") for c in ("name", "address")]
    body = blocking.document_frequency(adapter.split(adapter.whole_texts(spark, d))[0], "body").select(F.lit("body").alias("field"), "token", "df")
    return parts[0].unionByName(parts[1]).unionByName(body)


@query(f"WITH {_DOCS}{_KEYS} SELECT entity_id, key FROM qk")
def er_query_keys(spark: SparkSession, d: str) -> DataFrame:
    return blocking.reference_keys(_records(spark, d)[0], by_address=False)


@query(f"WITH {_DOCS}{_KEYS} SELECT entity_id, key FROM tkk")
def er_target_keys(spark: SparkSession, d: str) -> DataFrame:
    return blocking.target_keys(_records(spark, d)[1], by_address=False)


@query(f"WITH {_PARTIES}{_KEYS} SELECT entity_id, key FROM qk UNION SELECT * FROM aqk UNION SELECT * FROM tkk UNION SELECT * FROM atk")
def er_address_keys(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = adapter.split(adapter.parties(spark, d))
    return blocking.reference_keys(s1).unionByName(blocking.target_keys(targets))


_SORTED = "array_to_string(list_sort({0}), chr(1))"
_FORMS = ", ".join(f"'{x}'" for x in K.LEGAL_FORMS)


@query(f"""WITH {_DOCS}, c AS (SELECT *, list_filter({_TOK.format("name")}, lambda t: t NOT IN ({_FORMS})) AS core FROM rec)
SELECT entity_id, CASE WHEN len(core) > 0 THEN 'e' || chr(1) || {_SORTED.format("core")} ELSE 'n' || chr(1) || name END AS key FROM c
UNION ALL SELECT entity_id, 'x' || chr(1) || {_SORTED.format(_TOK.format("address"))} FROM c WHERE address <> ''""")
def er_exact_keys(spark: SparkSession, d: str) -> DataFrame:
    return blocking.target_keys(adapter.documents(spark, d), exact=True)


@query(f"""WITH {_DOCS} SELECT entity_id, md5('x' || chr(1) || {_SORTED.format(_TOK.format("body"))}) AS key FROM rec WHERE body <> '' UNION ALL SELECT entity_id, md5('n' || chr(1)) FROM rec""")
def er_exact_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Exact keys of whole texts, as digests: texts of the same words have the same key."""
    rows = adapter.whole_texts(spark, d).select("entity_id", F.lit("").alias("name"), F.col("body").alias("address"))
    return blocking.target_keys(rows, exact=True).select("entity_id", F.md5("key").alias("key"))


@query(f"WITH {_DOCS}{_KEYS}{_PAIRS} SELECT key, count(*) AS n, count(*) <= 10 AS kept FROM allq GROUP BY key")
def er_key_cap(spark: SparkSession, d: str) -> DataFrame:
    return blocking.key_frequency(blocking.reference_keys(_records(spark, d)[0])).withColumn("kept", F.col("n") <= blocking.MAX_KEY_FREQUENCY)


@query(f"{_CAND} SELECT s1_id, target_id FROM pr")
def er_block_pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocking.block(*_records(spark, d))


@query(f"{_CAND} SELECT s1_id, target_id, round(blocking_score, 9) AS blocking_score FROM sc")
def er_block_score(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = _records(spark, d)
    return blocking.scored(blocking.with_records(blocking.block(s1, targets), s1, targets)).select("s1_id", "target_id", F.round("blocking_score", 9).alias("blocking_score"))


@query(f"{_CAND} SELECT s1_id, target_id, target_source, round(blocking_score, 9) AS blocking_score, blocking_rank FROM tk WHERE blocking_rank <= {K_BEST}")
def er_topk(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("s1_id", "target_id", "target_source", F.round("blocking_score", 9).alias("blocking_score"), "blocking_rank")


_GRID = "g AS (SELECT fl AS floor, k::INT AS k FROM (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS fl), (SELECT unnest([5, 10, 20, 50]) AS k))"


@query(f"""{_CAND}, {_GRID}, gs AS (SELECT s1_id, floor, k FROM sp, g), gp AS (SELECT s1_id, target_id, floor, k FROM tk JOIN g ON blocking_score >= floor AND blocking_rank <= k AND blocking_rank <= 50),
per AS ({_counts("gp", spine="gs", by=", floor, k")})
SELECT floor, k, sum(n_predicted)::BIGINT AS pairs, round(sum(hits) / sum(n_true), 9) AS candidate_pair_recall, round(avg((hits = n_true)::INT), 9) AS entity_complete_coverage, round(avg(CASE WHEN n_true > 0 THEN (hits = n_true)::INT END), 9) AS matched_entity_complete_coverage FROM per GROUP BY floor, k""")
def er_block_curve(spark: SparkSession, d: str) -> DataFrame:
    _, _, spine, truth, ranked = _setting(spark, d, 50)
    out = blocking.block_curve(ranked, truth, spine)
    return out.select("floor", "k", "pairs", *[F.round(c, 9).alias(c) for c in out.columns[3:]])


_DIGITS = "list_filter({0}, lambda t: regexp_matches(t, '\\p{{Nd}}'))"
_RATIO = "least(length({0}), length({1})) / greatest(1, length({0}), length({1}))"
_FEATS = f"""ft AS (SELECT s1_id, target_id, name, address, target_name, target_address, nj AS name_jaccard, aj AS address_jaccard, (name = target_name)::INT::DOUBLE AS name_exact, (address <> '' AND address = target_address)::INT::DOUBLE AS address_exact,
 {_JACCARD.format(_DIGITS.format("qa"), _DIGITS.format("ta"))} AS numeric_jaccard, (len({_DIGITS.format("qa")}) > 0 AND len({_DIGITS.format("ta")}) > 0 AND len(list_intersect({_DIGITS.format("qa")}, {_DIGITS.format("ta")})) = 0)::INT::DOUBLE AS numeric_conflict,
 (country = target_country)::INT::DOUBLE AS country_match, {_RATIO.format("name", "target_name")} AS name_length_ratio, {_RATIO.format("address", "target_address")} AS address_length_ratio, (address = '' OR target_address = '')::INT::DOUBLE AS address_missing FROM tk WHERE blocking_rank <= {K_BEST})"""
_NEUTRAL = ("address_jaccard", "address_exact", "numeric_jaccard", "numeric_conflict", "address_length_ratio")
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in TOKEN_FEATURES)


def _features(pairs: DataFrame, neutral: bool = False) -> DataFrame:
    found = token_features(*(F.col(c) for c in ("name", "address", "country", "target_name", "target_address", "target_country")), neutral_missing=neutral)
    return pairs.select("s1_id", "target_id", *[F.round(c, 9).alias(n) for n, c in found.items()])


@query(f"{_CAND}, {_FEATS} SELECT s1_id, target_id, {_ROUNDED} FROM ft")
def er_pair_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(_candidates(spark, d))


@query(f"{_CANDP}, {_FEATS} SELECT s1_id, target_id, {_ROUNDED} FROM ft")
def er_numeric_features(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = adapter.split(adapter.parties(spark, d))
    return _features(blocking.candidates(s1, targets, K_BEST))


@query(f"{_CAND}, {_FEATS} SELECT s1_id, target_id, {', '.join(f'CASE WHEN address_missing = 0 THEN round({c}, 9) END AS {c}' if c in _NEUTRAL else f'round({c}, 9) AS {c}' for c in TOKEN_FEATURES)} FROM ft")
def er_features_missing_v2(spark: SparkSession, d: str) -> DataFrame:
    return _features(_candidates(spark, d), True)


#: DuckDB's levenshtein counts bytes, so each pair's letters are numbered and stand as one byte each.
_LETTERS = "list_distinct(string_split({0} || {1}, ''))"
_CODED = "array_to_string(list_transform(string_split({0}, ''), lambda c: chr((32 + list_position(letters, c))::INT)), '')"


@query(f"""{_CAND}, {_FEATS}, l AS (SELECT s1_id, target_id, name, target_name, {_LETTERS.format("name", "target_name")} AS letters FROM ft)
SELECT s1_id, target_id, round(CASE WHEN name || target_name = '' THEN 1 ELSE 1 - levenshtein({_CODED.format("name")}, {_CODED.format("target_name")}) / greatest(length(name), length(target_name), 1) END, 9) AS name_levenshtein FROM l""")
def er_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    pairs = _candidates(spark, d)
    return pairs.select("s1_id", "target_id", F.round(levenshtein_similarity(F.col("name"), F.col("target_name")), 9).alias("name_levenshtein"))


def _subsequence_sql(rows: str, a: str, b: str, name: str) -> str:
    """Length of the longest common subsequence: a row of the usual table for each letter of a, its running maxima over b."""
    return f"""{name}r AS (SELECT s1_id, target_id, 0 AS i, string_split({a}, '') AS xa, string_split({b}, '') AS xb, length({a}) AS na, length({b}) AS nb, list_transform(generate_series(0, length({b})), lambda j: 0) AS row FROM {rows}
 UNION ALL SELECT s1_id, target_id, i + 1, xa, xb, na, nb, list_transform(generate_series(0, nb), lambda j: coalesce(list_max(list_transform(generate_series(1, j), lambda k: greatest(row[k + 1], row[k] + (xb[k] = xa[i + 1])::INT))), 0)) FROM {name}r WHERE i < na),
{name} AS (SELECT s1_id, target_id, CASE WHEN na + nb = 0 THEN 1 ELSE 2.0::DOUBLE * row[nb + 1] / (na + nb) END AS {name}_ratio FROM {name}r WHERE i = na)"""


_WORDS_SORTED = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda t: t <> '')), ' ')"
_SORTED_NAMES = ", ".join(f"{_WORDS_SORTED.format(c)} AS {n}" for c, n in (("name", "a"), ("target_name", "b"), ("address", "c"), ("target_address", "e")))


@query(f"""{_CAND.replace("WITH ", "WITH RECURSIVE ", 1)}, so AS (SELECT s1_id, target_id, {_SORTED_NAMES} FROM tk WHERE blocking_rank <= {K_BEST}), {_subsequence_sql("so", "a", "b", "nm")}, {_subsequence_sql("so", "c", "e", "ad")}
SELECT s1_id, target_id, round(nm_ratio, 9) AS name_token_sort, round(CASE WHEN c = '' OR e = '' THEN 0 ELSE ad_ratio END, 9) AS address_token_sort FROM so JOIN nm USING (s1_id, target_id) JOIN ad USING (s1_id, target_id)""")
def er_token_sort(spark: SparkSession, d: str) -> DataFrame:
    found = edit_features(*(F.col(c) for c in ("name", "address", "target_name", "target_address")))
    return _candidates(spark, d).select("s1_id", "target_id", *[F.round(found[c], 9).alias(c) for c in ("name_token_sort", "address_token_sort")])


@query()
def er_edit_features(spark: SparkSession, d: str) -> DataFrame:
    pairs = _candidates(spark, d)
    found = edit_features(*(F.col(c) for c in ("name", "address", "target_name", "target_address")))
    return pairs.select("s1_id", "target_id", *[found[c].alias(c) for c in EDIT_FEATURES])


_Z = " + ".join(f"coalesce({c}, 0) * ({w}::DOUBLE)" for c, w in zip(TOKEN_FEATURES, WEIGHTS, strict=True))
_SCORED = f"{_CAND}, {_FEATS}, lg AS (SELECT s1_id, target_id, round(1 / (1 + exp(-({INTERCEPT}::DOUBLE + {_Z}))), 6) AS score FROM ft)"


def _scored(pairs: DataFrame) -> DataFrame:
    return with_features(pairs, edit=False).withColumn("score", F.round(logistic_score(TOKEN_FEATURES, WEIGHTS, INTERCEPT), 6))


@query(f"{_SCORED} SELECT s1_id, target_id, score FROM lg")
def er_logistic_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_candidates(spark, d)).select("s1_id", "target_id", "score")


def _lists_sql(rows: str, name: str) -> str:
    return f"SELECT sp.s1_id, coalesce(string_agg(p.target_id, ',' ORDER BY p.target_id), '') AS {name} FROM sp LEFT JOIN {rows} p ON p.s1_id = sp.s1_id GROUP BY sp.s1_id"


@query(f"{_SCORED}, p AS (SELECT * FROM lg WHERE score >= {THRESHOLD}) {_lists_sql('p', 'matched_entity_ids')}")
def er_predict_lists(spark: SparkSession, d: str) -> DataFrame:
    s1, _, spine, _, ranked = _setting(spark, d)
    return evaluate.as_lists(spine, evaluate.predict(_scored(ranked), THRESHOLD), "matched_entity_ids")


@query(f"{_CAND}, p AS (SELECT * FROM tk WHERE blocking_rank <= {K_BEST}) {_lists_sql('p', 'candidate_entity_ids')}")
def er_candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    _, _, spine, _, ranked = _setting(spark, d)
    return evaluate.as_lists(spine, ranked, "candidate_entity_ids")


_PRED = f"{_SCORED}, p AS (SELECT * FROM lg WHERE score >= {THRESHOLD}), per AS ({_counts('p')})"


def _predicted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    _, targets, spine, truth, ranked = _setting(spark, d)
    return targets, spine, truth, stage(evaluate.predict(_scored(ranked), THRESHOLD).select("s1_id", "target_id", "score"))


@query(f"{_PRED} SELECT s1_id, n_true, n_predicted, hits, round({_F}, 9) AS f05 FROM per")
def er_entity_f05(spark: SparkSession, d: str) -> DataFrame:
    _, spine, truth, predicted = _predicted(spark, d)
    per = evaluate.counts_by_entity(spine, truth, predicted)
    return per.withColumn("f05", F.round(evaluate.entity_f05(F.col("n_true"), F.col("n_predicted"), F.col("hits")), 9))


@query(f"{_PRED} SELECT {_METRICS} FROM per")
def er_macro_eval(spark: SparkSession, d: str) -> DataFrame:
    _, spine, truth, predicted = _predicted(spark, d)
    return _rounded(evaluate.metrics(evaluate.counts_by_entity(spine, truth, predicted)))


@query(f"""{_CAND}, p AS (SELECT * FROM tk WHERE blocking_rank <= {K_BEST}), per AS ({_counts("p")})
SELECT sum(n_predicted)::BIGINT AS pairs, round(sum(hits) / sum(n_true), 9) AS candidate_pair_recall, round(avg((hits = n_true)::INT), 9) AS entity_complete_coverage, round(avg(CASE WHEN n_true > 0 THEN (hits = n_true)::INT END), 9) AS matched_entity_complete_coverage FROM per""")
def er_blocking_metrics(spark: SparkSession, d: str) -> DataFrame:
    _, _, spine, truth, ranked = _setting(spark, d)
    out = evaluate.coverage(evaluate.counts_by_entity(spine, truth, ranked))
    return out.select("pairs", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(f"""{_PRED}, src AS (SELECT 'source:S2' AS slice, 'S2-%' AS pat UNION ALL SELECT 'source:S3', 'S3-%'),
ss AS (SELECT s1_id, slice FROM sp, src), sps AS (SELECT s1_id, target_id, slice FROM p JOIN src ON target_id LIKE pat), strr AS (SELECT s1_id, target_id, slice FROM tr JOIN src ON target_id LIKE pat),
x AS (SELECT 'ALL' AS slice, n_true, n_predicted, hits FROM per UNION ALL SELECT 'country:' || country, n_true, n_predicted, hits FROM per JOIN sp USING (s1_id)
 UNION ALL SELECT ss.slice, coalesce(t.n, 0), coalesce(q.n, 0), coalesce(q.h, 0) FROM ss LEFT JOIN (SELECT s1_id, slice, count(*) AS n FROM strr GROUP BY 1, 2) t USING (s1_id, slice)
 LEFT JOIN (SELECT y.s1_id, y.slice, count(*) AS n, count(z.s1_id) AS h FROM sps y LEFT JOIN strr z USING (s1_id, target_id, slice) GROUP BY 1, 2) q USING (s1_id, slice))
SELECT slice, {_METRICS} FROM x GROUP BY slice""")
def er_slices(spark: SparkSession, d: str) -> DataFrame:
    targets, spine, truth, predicted = _predicted(spark, d)
    return _rounded(evaluate.slices(spine, truth, predicted, targets))


_T = ", ".join(str(t) for t in sorted(evaluate.COARSE))


@query(f"""{_SCORED}, g AS (SELECT unnest([{_T}])::DOUBLE AS threshold), gs AS (SELECT s1_id, threshold FROM sp, g), gp AS (SELECT s1_id, target_id, threshold FROM lg JOIN g ON score >= threshold),
per AS ({_counts("gp", spine="gs", by=", threshold")}) SELECT threshold, round(avg({_F}), 9) AS macro_f05 FROM per GROUP BY threshold""")
def er_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    _, _, spine, truth, ranked = _setting(spark, d)
    return _rounded(evaluate.threshold_metrics(spine, truth, _scored(ranked)))


@query(f"""{_SCORED}, m AS (SELECT sp.s1_id, coalesce(max(score), 0) AS best, sp.s1_id IN (SELECT s1_id FROM tr) AS matched FROM sp LEFT JOIN lg USING (s1_id) GROUP BY sp.s1_id)
SELECT matched, count(*) AS n, min(best) AS low, round(quantile_cont(best, 0.25), 6) AS p25, round(quantile_cont(best, 0.5), 6) AS p50, round(quantile_cont(best, 0.75), 6) AS p75, round(quantile_cont(best, 0.95), 6) AS p95, max(best) AS high FROM m GROUP BY matched""")
def er_max_score(spark: SparkSession, d: str) -> DataFrame:
    _, _, spine, truth, ranked = _setting(spark, d)
    out = evaluate.score_quantiles(spine, truth, _scored(ranked))
    return out.select("matched", "n", "low", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75", "p95")], "high")


_POISSON = [0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815183, 0.999916758851, 0.999989750804, 0.999998874798, 0.999999888575, 0.999999989952, 0.999999999168]
_DRAWN = "('0x' || substr(md5(s1_id || ':' || round || ':2026'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""{_PRED}, x AS (SELECT s1_id, {_F} AS f FROM per), u AS (SELECT round, f, {_DRAWN} AS u FROM x, (SELECT unnest(generate_series(0, 999)) AS round)),
m AS (SELECT round, sum(f * w) / sum(w) AS mean FROM (SELECT round, f, {" + ".join(f"(u >= {p}::DOUBLE)::INT" for p in _POISSON)} AS w FROM u) GROUP BY round)
SELECT round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM m""")
def er_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    _, spine, truth, predicted = _predicted(spark, d)
    found = evaluate.bootstrap(evaluate.counts_by_entity(spine, truth, predicted))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def _grams(text: str) -> str:
    return "list_concat(" + ", ".join(f"CASE WHEN length({text}) >= {n} THEN list_transform(generate_series(1, length({text}) - {n - 1}), lambda i: substr({text}, i, {n})) ELSE [] END" for n in (3, 4, 5)) + ")"


def _weights(rows: str, name: str) -> str:
    return f"""{name}c AS (SELECT doc, gram, count(*) AS tf FROM (SELECT doc, unnest({_grams("text")}) AS gram FROM {rows}) GROUP BY 1, 2),
{name}i AS (SELECT gram, ln((1 + (SELECT count(*) FROM {rows})) / (1 + count(*))) + 1 AS idf FROM {name}c GROUP BY gram),
{name}r AS (SELECT doc, gram, tf * idf AS w FROM {name}c JOIN {name}i USING (gram)), {name} AS (SELECT doc, gram, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM {name}r)"""


@query(f"""WITH {_DOCS}, t AS (SELECT entity_id AS doc, name AS text FROM rec), {_weights("t", "wt")},
s AS (SELECT q.doc AS s1_id, x.doc AS target_id, substr(x.doc, 1, 2) AS target_source, round(sum(q.weight * x.weight), 6) AS score FROM wt q JOIN wt x USING (gram) WHERE q.doc LIKE 'S1-%' AND x.doc NOT LIKE 'S1-%' GROUP BY 1, 2, 3 HAVING round(sum(q.weight * x.weight), 6) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY s1_id, target_source ORDER BY score DESC, target_id)::INT AS rank FROM s) SELECT * FROM k WHERE rank <= 3""")
def er_tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = _records(spark, d)
    return tfidf.retrieve(s1.select("entity_id", "source", F.col("name").alias("text")), targets.select("entity_id", "source", F.col("name").alias("text")), 3, None).select("s1_id", "target_id", "target_source", "score", "rank")


@query(f"""{_CAND}, t AS (SELECT entity_id AS doc, name AS text FROM rec), {_weights("t", "wt")},
c AS (SELECT s1_id, target_id, sum(q.weight * x.weight) AS c FROM tk JOIN wt q ON q.doc = s1_id JOIN wt x ON x.doc = target_id AND x.gram = q.gram WHERE blocking_rank <= {K_BEST} GROUP BY 1, 2)
SELECT s1_id, target_id, round(coalesce(c, 0), 6) AS name_cosine FROM tk LEFT JOIN c USING (s1_id, target_id) WHERE blocking_rank <= {K_BEST}""")
def er_pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    records = adapter.documents(spark, d)
    w = tfidf.weights(records.select(F.col("entity_id").alias("doc"), F.col("name").alias("text")))
    return tfidf.pair_cosine(_candidates(spark, d).select("s1_id", "target_id"), w, "name_cosine").select("s1_id", "target_id", F.round("name_cosine", 6).alias("name_cosine"))


_PLACE = "('0x' || substr(md5(entity_id || ':2026'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"WITH {_DOCS} SELECT entity_id AS s1_id, CASE WHEN {_PLACE} < 0.6 THEN 'train' WHEN {_PLACE} < 0.8 THEN 'calibration' ELSE 'validation' END AS split FROM rec WHERE source = 'S1'")
def er_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.three_way(_records(spark, d)[0].select(F.col("entity_id").alias("s1_id")))


@query(f"WITH {_DOCS} SELECT entity_id AS s1_id FROM rec WHERE source = 'S1' ORDER BY md5(entity_id || ':2028'), entity_id LIMIT 100")
def er_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(_records(spark, d)[0].select(F.col("entity_id").alias("s1_id")), 100, 2028)


_LONG = "l AS (SELECT source, 'name' AS field, length(name) AS n FROM rec UNION ALL SELECT source, 'address', length(address) FROM rec UNION ALL SELECT source, 'country', length(country) FROM rec)"


@query(f"""WITH {_DOCS}, {_LONG} SELECT source, field, count(*) AS rows, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS low, max(n) AS high, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75,
quantile_disc(n, 0.25) AS p25, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.75) AS p75, quantile_disc(n, 0.95) AS p95 FROM l GROUP BY source, field""")
def er_audit_lengths(spark: SparkSession, d: str) -> DataFrame:
    return audit.lengths(adapter.documents(spark, d))


@query(f"WITH {_DOCS} SELECT source, count(*) AS rows, count(*) FILTER (trim(name) = '') AS blank_name, count(*) FILTER (trim(address) = '') AS blank_address, count(*) FILTER (trim(country) = '') AS blank_country, (count(*) - count(DISTINCT entity_id)) AS duplicate_ids FROM rec GROUP BY source")
def er_audit_missing(spark: SparkSession, d: str) -> DataFrame:
    return audit.missing(adapter.documents(spark, d))


@query(f"WITH {_DOCS} SELECT source, country, count(*) AS rows FROM rec GROUP BY source, country")
def er_countries(spark: SparkSession, d: str) -> DataFrame:
    return audit.countries(adapter.documents(spark, d))


@query(f"{_CAND}, n AS (SELECT country, (SELECT count(*) FROM tr WHERE tr.s1_id = sp.s1_id) AS links FROM sp) SELECT country, links, count(*) AS records FROM n GROUP BY country, links")
def er_match_hist(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = _records(spark, d)
    return audit.match_histogram(adapter.spine(s1), adapter.truth(s1, targets))


@query(f"{_CAND}, n AS (SELECT target_id, count(DISTINCT s1_id) AS n FROM tr GROUP BY target_id) SELECT count(*) AS targets, count(*) FILTER (n > 1) AS shared, coalesce(max(n), 0) AS most FROM n")
def er_shared_targets(spark: SparkSession, d: str) -> DataFrame:
    return audit.shared_targets(adapter.truth(*_records(spark, d)))


@query(f"{_CAND} SELECT substr(target_id, 1, 2) AS source, count(*) AS links FROM tr GROUP BY 1")
def er_links_by_source(spark: SparkSession, d: str) -> DataFrame:
    return audit.links_by_source(adapter.truth(*_records(spark, d)))


@query(f"""{_SCORED}, o AS (SELECT s1_id, target_id FROM lg WHERE score >= 0.5), w AS (SELECT s1_id, target_id FROM lg WHERE score >= 0.8),
d AS (SELECT s1_id, o.target_id IS NULL AS added, w.target_id IS NULL AS removed FROM o FULL JOIN w USING (s1_id, target_id)),
e AS (SELECT s1_id, count(*) FILTER (added) AS a, count(*) FILTER (removed) AS r, count(*) FILTER (NOT added) AS was, count(*) FILTER (NOT removed) AS isn FROM d GROUP BY s1_id)
SELECT coalesce(sum(a), 0)::BIGINT AS added, coalesce(sum(r), 0)::BIGINT AS removed, count(*) FILTER (a + r > 0) AS changed, count(*) FILTER (was > 0 AND isn = 0) AS emptied FROM e""")
def er_output_diff(spark: SparkSession, d: str) -> DataFrame:
    _, _, spine, _, ranked = _setting(spark, d)
    scored = _scored(ranked)
    return evaluate.output_diff(spine, evaluate.predict(scored, 0.5), evaluate.predict(scored, 0.8))


_BAD = """bad AS (SELECT s1_id, CASE WHEN hash_of % 7 = 0 THEN ids || ',' || ids WHEN hash_of % 7 = 1 THEN ids || ',S1-0,X-1' ELSE ids END AS ids FROM (SELECT sp.s1_id, substr(sp.s1_id, 4)::BIGINT AS hash_of, coalesce(string_agg(p.target_id, ',' ORDER BY p.target_id), '') AS ids FROM sp LEFT JOIN p USING (s1_id) GROUP BY sp.s1_id) WHERE hash_of % 11 <> 0),
ids AS (SELECT s1_id, CASE WHEN trim(ids) = '' THEN [] ELSE string_split(ids, ',') END AS l FROM bad), e AS (SELECT s1_id, unnest(l) AS id FROM ids)"""


def _broken(lists: DataFrame) -> DataFrame:
    """Result lists with faults planted by the records' numbers."""
    number, ids = F.substring("s1_id", 4, 20).cast("long"), F.col("matched_entity_ids")
    made = F.when(number % 7 == 0, F.concat(ids, F.lit(","), ids)).when(number % 7 == 1, F.concat(ids, F.lit(",S1-0,X-1"))).otherwise(ids)
    rows = lists.where(number % 11 != 0).select("s1_id", made.alias("text"))
    return rows.select("s1_id", F.when(F.trim("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", ",")).alias("ids"))


def _finding_sql(rule: str, ids: str) -> str:
    return f"SELECT 'matching' AS file, 'error' AS level, '{rule}' AS rule, count(DISTINCT id) AS n, array_to_string(list_sort(list(DISTINCT id))[1:5], ',') AS examples FROM ({ids}) HAVING count(*) > 0"


@query(
    f"{_SCORED}, p AS (SELECT * FROM lg WHERE score >= {THRESHOLD}), {_BAD} "
    + " UNION ALL ".join(
        _finding_sql(*x)
        for x in (
            ("repeated_id", "SELECT s1_id AS id FROM ids WHERE len(l) <> len(list_distinct(l))"),
            ("self_match", "SELECT id FROM e WHERE id LIKE 'S1-%'"),
            ("wrong_prefix", "SELECT id FROM e WHERE id NOT LIKE 'S1-%' AND id NOT LIKE 'S2-%' AND id NOT LIKE 'S3-%'"),
            ("missing_record", "SELECT s1_id AS id FROM sp WHERE s1_id NOT IN (SELECT s1_id FROM ids)"),
            ("unknown_target", "SELECT id FROM e WHERE (id LIKE 'S2-%' OR id LIKE 'S3-%') AND id NOT IN (SELECT entity_id FROM rec)"),
        )
    )
)
def er_validate_findings(spark: SparkSession, d: str) -> DataFrame:
    _, targets, spine, _, ranked = _setting(spark, d)
    lists = evaluate.as_lists(spine, evaluate.predict(_scored(ranked), THRESHOLD), "matched_entity_ids")
    return validate.list_findings("matching", _broken(lists), spine, targets)


@query(f"{_CAND} SELECT tr.s1_id, tr.target_id FROM tr WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.s1_id = tr.s1_id AND tk.target_id = tr.target_id AND blocking_rank <= 2)")
def er_containment(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, truth, ranked = _setting(spark, d, 2)
    return validate.not_contained(truth, ranked)


@query(f"{_CAND} SELECT s1_id, target_id, ((s1_id, target_id) IN (SELECT (s1_id, target_id) FROM tr))::INT::DOUBLE AS label FROM tk WHERE blocking_rank <= {K_BEST}")
def er_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, truth, ranked = _setting(spark, d)
    return model.labelled(ranked.select("s1_id", "target_id"), truth)


@query(f"{_CAND} SELECT entity_id AS target_id FROM rec WHERE source <> 'S1' AND entity_id NOT IN (SELECT target_id FROM pr)")
def er_anti_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Targets that no reference record's keys reach."""
    s1, targets = _records(spark, d)
    return targets.select(F.col("entity_id").alias("target_id")).join(blocking.block(s1, targets), "target_id", "left_anti")


@query("""SELECT item_id, CASE item_id % 8 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 7 THEN 1 WHEN 4 THEN 1 WHEN 0 THEN 0 ELSE -1 END AS n_ids, CASE WHEN item_id % 8 IN (1, 2, 3, 7) THEN 'S2-' || item_id WHEN item_id % 8 = 4 THEN ' ' ELSE '' END AS first_id,
 item_id % 8 IN (3, 4, 5, 6) AS bad FROM benchmark""")
def er_id_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of all forms: empty, commas, JSON, a padded id, a blank, JSON with a number, JSON that is no list, one id."""
    i, n = F.col("item_id").cast("string"), F.col("item_id") % 8
    forms = ["", "S2-#,S3-#", '["S2-#"]', "S2-#, S3-#", " ", '["S2-#", 1]', "[oops", "S2-#"]
    text = F.coalesce(*[F.when(n == k, F.replace(F.lit(x), F.lit("#"), i)) for k, x in enumerate(forms)])
    ids = id_list(text)
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.coalesce(F.size(ids), F.lit(-1)).alias("n_ids"), F.coalesce(F.get(ids, 0), F.lit("")).alias("first_id"), bad_ids(ids).alias("bad"))


@query()
def er_trees(spark: SparkSession, d: str) -> DataFrame:
    """Scores of boosted trees, fitted on 60 % of the records, for the candidates of the others."""
    s1, _, _, truth, ranked = _setting(spark, d)
    pairs = with_features(ranked, neutral_missing=True, edit=False).persist()
    split = sampling.three_way(s1.select(F.col("entity_id").alias("s1_id")))
    bundle = model.fit(model.labelled(pairs.join(split.where("split = 'train'"), "s1_id", "left_semi"), truth), list(TOKEN_FEATURES), "trees", iterations=10)
    return bundle.score(pairs.join(split.where("split <> 'train'"), "s1_id", "left_semi")).select("s1_id", "target_id", "score")


# Sources and sinks: what is written is read back, and SQL tells from the tables what must come.


def _write_records(spark: SparkSession, records: DataFrame, name: str) -> str:
    path = f"{work_folder(spark)}/{name}"
    records.select("entity_id", F.col("name").alias("business_name"), F.col("address").alias("business_address"), "country").write.option("sep", "\t").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


@query(f"WITH {_PARTIES} SELECT entity_id, name AS business_name, address AS normalized_address, {_CLEAN.format('country')} AS normalized_country, name || ' ' || address AS retrieval_text FROM rec")
def er_read_records(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_records(spark, _write_records(spark, adapter.parties(spark, d), "records")).select("entity_id", "business_name", "normalized_address", "normalized_country", "retrieval_text")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    records = adapter.documents(spark, d)
    return readers.read_sources(spark, {f"s{n}": _write_records(spark, records.where(F.col("source") == f"S{n}"), f"s{n}") for n in (1, 2, 3)})


@query(f"WITH {_DOCS} SELECT entity_id, source, name AS normalized_name, address AS normalized_address, {_CLEAN.format('country')} AS normalized_country FROM rec")
def er_read_sources(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("entity_id", "source", "normalized_name", "normalized_address", "normalized_country")


@query(f"{_CAND} SELECT s1_id, target_id FROM tr")
def er_read_truth(spark: SparkSession, d: str) -> DataFrame:
    s1, targets, spine, truth, _ = _setting(spark, d)
    path = f"{work_folder(spark)}/truth"
    sinks.write_scored(evaluate.as_lists(spine, truth, "matched_entity_ids").withColumnRenamed("s1_id", "source1_entity_id"), path)
    return readers.read_truth(spark, path, s1.unionByName(targets))


@query(f"{_CAND} SELECT s1_id AS source1_entity_id, target_id AS target_entity_id, target_name, target_address, target_country, target_source, round(blocking_score, 9) AS blocking_score, blocking_rank FROM tk WHERE blocking_rank <= {K_BEST}")
def er_candidate_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_folder(spark)}/candidates"
    sinks.write_jsonl(_candidates(spark, d).withColumnsRenamed({"s1_id": "source1_entity_id", "target_id": "target_entity_id"}), path)
    return readers.read_jsonl(spark, path, readers.CANDIDATES).withColumn("blocking_score", F.round("blocking_score", 9))


@query(f"{_SCORED} SELECT s1_id AS source1_entity_id, target_id AS target_entity_id, score FROM lg")
def er_score_import(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_folder(spark)}/scores"
    scored = stage(_scored(_candidates(spark, d)).select(F.col("s1_id").alias("source1_entity_id"), F.col("target_id").alias("target_entity_id"), "score"))
    sinks.write_jsonl(scored, path)
    return readers.import_scores(spark, path, scored.select("source1_entity_id", "target_entity_id"))


@query(f"{_CAND} SELECT s1_id, target_id, round(blocking_score, 9) AS score, blocking_rank AS rank FROM tk WHERE blocking_rank <= {K_BEST}")
def er_scored_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_folder(spark)}/scored"
    sinks.write_scored(_candidates(spark, d).select("s1_id", "target_id", F.col("blocking_score").alias("score"), F.col("blocking_rank").alias("rank")), path)
    return readers.read_scored(spark, path).withColumn("score", F.round("score", 9))


@query(f"{_SCORED}, p AS (SELECT * FROM lg WHERE score >= {THRESHOLD}), c AS (SELECT * FROM tk WHERE blocking_rank <= {K_BEST}), m AS ({_lists_sql('p', 'matched')}), l AS ({_lists_sql('c', 'candidates')}) SELECT s1_id, matched, candidates, row_number() OVER (ORDER BY substr(s1_id, 4)::BIGINT) - 1 AS position FROM m JOIN l USING (s1_id)")
def er_submission(spark: SparkSession, d: str) -> DataFrame:
    """Both outputs as they are read from the files written, in the order of the files' lines."""
    _, targets, spine, _, ranked = _setting(spark, d)
    folder = f"{work_folder(spark)}/out"
    ordered = spine.select("s1_id", F.substring("s1_id", 4, 20).cast("long").alias("position"))
    sinks.write_submission(folder, ordered, targets, ranked, evaluate.predict(_scored(ranked), THRESHOLD))
    read = lambda name: readers.read_tsv(spark, f"{folder}/{name}.tsv")
    lines = read("matching_results").select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_ids").alias("matched"), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("line"))
    numbered = lines.withColumn("position", (F.row_number().over(Window.orderBy("line")) - 1).cast("long")).drop("line")  # a check of the order, not an output
    return numbered.join(read("candidate_pairs").select(F.col("source1_entity_id").alias("s1_id"), F.col("candidate_entity_ids").alias("candidates")), "s1_id")


_TEXT = "'RECORD {0}' || chr(10) || '[NAME] ' || {1}name || chr(10) || '[ADDRESS] ' || {1}address || chr(10) || '[COUNTRY] ' || {1}country"


@query(f"{_CAND} SELECT s1_id AS source1_entity_id, target_id AS target_entity_id, {_TEXT.format('A', '')} AS text_a, {_TEXT.format('B', 'target_')} AS text_b FROM tk WHERE blocking_rank <= {K_BEST}")
def er_pair_export(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_folder(spark)}/texts"
    sinks.write_pair_texts(_candidates(spark, d), path)
    return readers.read_jsonl(spark, path, "source1_entity_id string, target_entity_id string, text_a string, text_b string")


@query(f"{_CAND} SELECT s1_id, target_id, sha256({_TEXT.format('A', '')}) AS digest FROM tk WHERE blocking_rank <= {K_BEST}")
def er_pair_digest(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("s1_id", "target_id", F.sha2(pair_text("name", "address", "country", "A"), 256).alias("digest"))


@query(f"WITH {_DOCS} SELECT entity_id FROM rec WHERE source = 'S2'")
def er_read_ids(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_ids(spark, _write_records(spark, adapter.documents(spark, d).where("source = 'S2'"), "ids"))


_REVIEW = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'false_positive' ELSE 'false_negative' END AS case_type, CASE doc_id % 5 WHEN 0 THEN 'alias' WHEN 1 THEN 'noise' WHEN 2 THEN 'shared' WHEN 3 THEN 'alias' ELSE 'other' END AS error_category FROM labels"
_KINDS, _LEAST = {"embedding": ("alias",), "ceiling": ("noise", "shared")}, {"embedding": 0.4, "ceiling": 0.5}


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """A review sheet made from the labels' numbers, written as CSV and read again."""
    i, path = F.col("doc_id"), f"{work_folder(spark)}/review"
    category = F.coalesce(*[F.when(i % 5 == k, F.lit(x)) for k, x in enumerate(("alias", "noise", "shared", "alias", "other"))])
    rows = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.when(i % 3 == 0, "false_positive").otherwise("false_negative").alias("case_type"), category.alias("error_category"))
    rows.write.option("header", True).csv(path)
    return readers.read_review(spark, path)


@query(f"""WITH r AS ({_REVIEW}), n AS (SELECT case_type, error_category, count(*) AS n FROM r GROUP BY 1, 2)
SELECT case_type, error_category, n, round(n / sum(n) OVER (PARTITION BY case_type), 9) AS share, CASE error_category WHEN 'alias' THEN 'embedding' WHEN 'other' THEN NULL ELSE 'ceiling' END AS gate FROM n""")
def er_review(spark: SparkSession, d: str) -> DataFrame:
    return audit.review(_reviewed(spark, d), _KINDS).withColumn("share", F.round("share", 9))


@query(f"""WITH r AS ({_REVIEW}), x AS (SELECT count(*) AS t, count(*) FILTER (error_category = 'other') AS o, count(*) FILTER (error_category = 'alias') AS a, count(*) FILTER (error_category IN ('noise', 'shared')) AS c FROM r),
y AS (SELECT 'embedding' AS gate, a AS n, 0.4::DOUBLE AS least, t, o FROM x UNION ALL SELECT 'ceiling', c, 0.5::DOUBLE, t, o FROM x)
SELECT gate, n, round(n / t, 9) AS share, CASE WHEN n / t >= least THEN 'cleared' WHEN (n + o) / t >= least THEN 'indeterminate' ELSE 'not_cleared' END AS status FROM y""")
def er_review_gates(spark: SparkSession, d: str) -> DataFrame:
    return audit.review_gates(_reviewed(spark, d), _KINDS, _LEAST, ("other",)).withColumn("share", F.round("share", 9))


@query(f"WITH {_DOCS} SELECT entity_id, source FROM rec UNION ALL SELECT 'X' || entity_id, NULL FROM rec")
def er_source_of(spark: SparkSession, d: str) -> DataFrame:
    ids = adapter.documents(spark, d).select("entity_id")
    both = ids.unionByName(ids.select(F.concat(F.lit("X"), "entity_id").alias("entity_id")))
    return both.withColumn("source", source_of(F.col("entity_id")))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS x, CASE WHEN event_id % 5 > 0 THEN value END AS first, CASE WHEN event_id % 3 > 0 THEN value END AS inner FROM events")
def er_finite(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that JSON can't say, by themselves, in arrays and in structs."""
    v, i = F.col("value"), F.col("event_id")
    x = F.when(i % 3 == 0, float("nan")).otherwise(v)
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", x.alias("x"), F.array(F.when(i % 5 == 0, float("inf")).otherwise(v), F.lit(float("-inf"))).alias("a"), F.struct(F.struct(x.alias("y")).alias("s")).alias("t"))
    return finite_rows(rows).where("a[1] IS NULL").select("event_id", "x", F.get("a", 0).alias("first"), F.col("t.s.y").alias("inner"))


_MEANS, _SCALES = [0.1 * (i + 1) for i in range(10)], [0.5 + 0.05 * i for i in range(10)]


@query(f"""{_CAND}, {_FEATS} SELECT s1_id, target_id, round(1 / (1 + exp(-({INTERCEPT}::DOUBLE + {" + ".join(f"({c} - {m}::DOUBLE) / {x}::DOUBLE * ({w}::DOUBLE)" for c, w, m, x in zip(TOKEN_FEATURES, WEIGHTS, _MEANS, _SCALES, strict=True))}))), 6) AS score FROM ft""")
def er_folded_score(spark: SparkSession, d: str) -> DataFrame:
    """A logistic score whose scaler is folded into its weights."""
    weights, constant = linear_weights(WEIGHTS, INTERCEPT, _MEANS, _SCALES)
    return with_features(_candidates(spark, d), edit=False).select("s1_id", "target_id", F.round(logistic_score(TOKEN_FEATURES, weights, constant), 6).alias("score"))


def _fitted(field: str, text: str) -> str:
    """Weights by the grams of all reference records and of the distinct targets of candidates, and the candidates' cosine."""
    return f"""{field}t AS (SELECT entity_id AS doc, {text} AS text FROM rec WHERE source = 'S1' OR entity_id IN (SELECT target_id FROM tk WHERE blocking_rank <= {K_BEST})), {_weights(f"{field}t", f"{field}w")},
{field} AS (SELECT s1_id, target_id, sum(q.weight * x.weight) AS c FROM tk JOIN {field}w q ON q.doc = s1_id JOIN {field}w x ON x.doc = target_id AND x.gram = q.gram WHERE blocking_rank <= {K_BEST} GROUP BY 1, 2)"""


@query(f"""{_CAND}, {_fitted("cc", "name || ' ' || address")}, {_fitted("cn", "name")}, {_fitted("ca", "address")}
SELECT s1_id, target_id, round(coalesce(cc.c, 0), 6) AS combined_cosine, round(coalesce(cn.c, 0), 6) AS name_cosine, round(coalesce(ca.c, 0), 6) AS address_cosine, round(coalesce(cn.c, 0) * coalesce(ca.c, 0), 6) AS name_address_product
FROM tk LEFT JOIN cc USING (s1_id, target_id) LEFT JOIN cn USING (s1_id, target_id) LEFT JOIN ca USING (s1_id, target_id) WHERE blocking_rank <= {K_BEST}""")
def er_cosines(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = _records(spark, d)
    pairs = stage(blocking.candidates(s1, targets, K_BEST).select("s1_id", "target_id"))
    found = tfidf.with_cosines(pairs, s1, targets, None, None)
    return found.select("s1_id", "target_id", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query(f"{_CAND} SELECT DISTINCT target_id, md5(target_id || ':2026') AS h FROM tk WHERE blocking_rank <= {K_BEST} ORDER BY h, target_id LIMIT 50")
def er_fit_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fit_sample(_candidates(spark, d), 50).withColumn("h", sampling.hash_order(2026, "target_id"))


@query(f"""WITH {_DOCS}, o AS (SELECT entity_id, length(body) AS n, row_number() OVER (ORDER BY length(body), entity_id) - 1 AS r, count(*) OVER () AS t FROM rec), p AS (SELECT DISTINCT round_even(i * (t - 1) / 40, 0)::BIGINT AS r FROM o, (SELECT unnest(generate_series(0, 40)) AS i))
SELECT entity_id, n FROM o JOIN p USING (r)""")
def er_spaced_by_length(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.whole_texts(spark, d).select("entity_id", F.length("body").alias("n"))
    return sampling.spaced_by_length(rows, F.col("n"), 41, "entity_id")


@query(f"WITH {_DOCS} SELECT entity_id AS s1_id, CASE WHEN {_PLACE} < 0.8 THEN 'train' ELSE 'validation' END AS split FROM rec WHERE source = 'S1'")
def er_grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.grouped_split(_records(spark, d)[0].select(F.col("entity_id").alias("s1_id")))


@query(f"""WITH {_DOCS}, a AS (SELECT entity_id FROM rec WHERE source = 'S1' ORDER BY md5(entity_id || ':2026'), entity_id LIMIT 50)
SELECT entity_id AS s1_id FROM rec WHERE source = 'S1' AND entity_id NOT IN (SELECT entity_id FROM a) ORDER BY md5(entity_id || ':2028'), entity_id LIMIT 50""")
def er_fresh_sample(spark: SparkSession, d: str) -> DataFrame:
    ids = _records(spark, d)[0].select(F.col("entity_id").alias("s1_id"))
    return sampling.sample(ids, 50, 2028, without=sampling.sample(ids, 50, 2026))


@query(f"{_SCORED} SELECT x.entity_id AS s1_id, CASE WHEN {_PLACE} < 0.8 THEN 'train' ELSE 'validation' END AS split, (SELECT count(DISTINCT target_id) FROM tr WHERE tr.s1_id = x.entity_id) AS n_true, (SELECT max(score) FROM lg WHERE lg.s1_id = x.entity_id) AS max_score FROM rec x WHERE source = 'S1'".replace("md5(entity_id", "md5(x.entity_id"))
def er_score_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    _, _, spine, truth, ranked = _setting(spark, d)
    return evaluate.diagnostic(sampling.grouped_split(spine), truth, _scored(ranked))


@query(f"""{_CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY s1_id, target_source ORDER BY blocking_score DESC, target_id)::INT AS r FROM sc) SELECT s1_id, target_id, r AS rank FROM k WHERE r <= 3""")
def er_topk_smaller_ids(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = _records(spark, d)
    pairs = blocking.scored(blocking.with_records(blocking.block(s1, targets), s1, targets))
    return blocking.top_k(pairs, 3, rank="rank", descending_ids=False).select("s1_id", "target_id", "rank")


@query(f"{_CAND} SELECT s1_id, target_id, name, address, country, target_name, target_address, target_country, target_source FROM f")
def er_with_records(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = _records(spark, d)
    return blocking.with_records(blocking.block(s1, targets), s1, targets)


@query(f"""{_SCORED}, p AS (SELECT * FROM lg WHERE score >= {THRESHOLD}), {_BAD} SELECT (SELECT count(*) FROM (SELECT s1_id FROM ids GROUP BY 1 HAVING count(*) > 1)) AS duplicate_labels, (SELECT count(DISTINCT s1_id) FROM ids WHERE s1_id NOT IN (SELECT s1_id FROM sp)) AS unknown_records,
 (SELECT count(*) FROM sp WHERE s1_id NOT IN (SELECT s1_id FROM ids)) AS missing_records, (SELECT count(*) FROM ids WHERE len(l) <> len(list_distinct(l))) AS repeated_matches, (SELECT count(*) FROM e WHERE id NOT IN (SELECT entity_id FROM rec WHERE source <> 'S1')) AS unknown_targets""")
def er_label_findings(spark: SparkSession, d: str) -> DataFrame:
    _, targets, spine, _, ranked = _setting(spark, d)
    lists = evaluate.as_lists(spine, evaluate.predict(_scored(ranked), THRESHOLD), "matched_entity_ids")
    return audit.label_findings(stage(_broken(lists)), spine.select("s1_id"), targets)


@query(f"""{_CAND}, t AS (SELECT target_id, count(DISTINCT s1_id) AS n FROM tr GROUP BY 1 HAVING count(DISTINCT s1_id) > 1 ORDER BY n DESC, target_id LIMIT 10)
SELECT target_id, n, array_to_string((SELECT list_sort(list(DISTINCT s1_id))[1:5] FROM tr WHERE tr.target_id = t.target_id), ',') AS records FROM t""")
def er_shared_examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.shared_examples(stage(adapter.truth(*_records(spark, d))))


@query(f"{_SCORED}, c AS (SELECT * FROM tk WHERE blocking_rank <= {K_BEST}), p AS (SELECT * FROM lg WHERE score >= {THRESHOLD}) SELECT (SELECT count(*) FROM sp) AS records, (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM p) AS matches, (SELECT count(*) FROM sp WHERE s1_id NOT IN (SELECT s1_id FROM p)) AS unmatched")
def er_totals(spark: SparkSession, d: str) -> DataFrame:
    _, _, spine, _, ranked = _setting(spark, d)
    return evaluate.totals(spine, ranked, evaluate.predict(_scored(ranked), THRESHOLD))


@query(f"{_CAND} SELECT s1_id, target_id, round(least(length(a), length(b)) / greatest(length(a), length(b)), 9) AS score FROM (SELECT s1_id, target_id, {_TEXT.format('A', '')} AS a, {_TEXT.format('B', 'target_')} AS b FROM tk WHERE blocking_rank <= {K_BEST})")
def er_pair_scorer(spark: SparkSession, d: str) -> DataFrame:
    """The hook for rerankers with the simplest scorer: how alike in length two texts are."""
    texts = _candidates(spark, d).select("s1_id", "target_id", pair_text("name", "address", "country", "A").alias("text_a"), pair_text("target_name", "target_address", "target_country", "B").alias("text_b"))
    load = lambda: lambda a, b: [min(len(x), len(y)) / max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    return model.score_pairs(texts, load).select("s1_id", "target_id", F.round("score", 9).alias("score"))


@query(f"{_SCORED}, x AS (SELECT * FROM ft JOIN lg USING (s1_id, target_id)) SELECT s1_id, target_id, score, round(name_jaccard, 9) AS name_jaccard FROM x")
def er_aligned_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores that come from elsewhere beside the features of exactly their pairs."""
    pairs = stage(with_features(_candidates(spark, d), edit=False))
    scores = _scored(_candidates(spark, d)).select("s1_id", "target_id", "score")
    return readers.aligned(pairs, scores).select("s1_id", "target_id", "score", F.round("name_jaccard", 9).alias("name_jaccard"))


_XF = f"tt AS (SELECT entity_id, source, name, {_SORTED.format('list_filter(' + _TOK.format('name') + ', lambda t: t NOT IN (' + _FORMS + '))')} AS core, {_SORTED.format(_TOK.format('address'))} AS place, address FROM rec)"


@query(f"""WITH {_DOCS}, {_XF}, ke AS (SELECT entity_id, source, CASE WHEN core <> '' THEN 'e' || chr(1) || core ELSE 'n' || chr(1) || name END AS key FROM tt UNION SELECT entity_id, source, 'x' || chr(1) || place FROM tt WHERE address <> '')
SELECT DISTINCT q.entity_id AS s1_id, t.entity_id AS target_id FROM ke q JOIN ke t USING (key) WHERE q.source = 'S1' AND t.source <> 'S1'""")
def er_exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Blocking by exact keys, without a bound on their frequency."""
    return blocking.block(*_records(spark, d), None, exact=True)


@query(f"WITH {_DOCS} SELECT source, field, count(*) AS rows, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS low, max(n) AS high, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, quantile_disc(n, 0.25) AS p25, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.75) AS p75, quantile_disc(n, 0.95) AS p95 FROM (SELECT source, 'body' AS field, length(body) AS n FROM rec) GROUP BY source, field")
def er_audit_bodies(spark: SparkSession, d: str) -> DataFrame:
    return audit.lengths(adapter.whole_texts(spark, d), ("body",))
