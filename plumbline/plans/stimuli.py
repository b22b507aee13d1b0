"""Queries of the stimulus and scoring layers (inventory A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, stimuli
from ..functions.text import digest, sentences, word_count
from ..operators.quantiles import quantiles
from ..sources.tables import answers, table, upsert

QUERIES, ORACLES = {}, {}

A = "a AS (SELECT doc_id, source AS cluster, lang, 'q' || doc_id AS question, coalesce(text, '') AS answer FROM documents)"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SENT = r"list_filter(string_split(regexp_replace(" + STRIP + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
U = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"
S = f"s AS (SELECT doc_id, answer, {SENT.format('answer')} AS s FROM a)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def many(xs: list[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _out(df, *keys):
    return df.select(*keys, F.length("v").cast("long").alias("n_chars"), digest(F.col("v")).alias("sha"))


OUT = "length(v)::BIGINT AS n_chars, sha256(v) AS sha"


@add("b2_sentences", f"WITH {A}, {S} SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM s")
def b2(spark, d):
    s = sentences(F.col("answer"))
    return answers(spark, d).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


_LOW = "lower(x[1:1]) || x[2:]"
_SQL = {
    "padding": lambda n: f"answer || ' ' || {quoted(' '.join(stimuli.FILLER[:n]))}",
    "elaboration": lambda n: f"answer || ' ' || coalesce(array_to_string(s[1:{n}], ' '), '')",
    "flattery": lambda n: f"{quoted(stimuli.FLATTERY[n - 1] + ' ')} || answer",
    "self_praise": lambda n: f"answer || {quoted(' ' + stimuli.SELF_PRAISE[n - 1])}",
    "emoji": lambda n: f"coalesce(array_to_string(list_transform(s, lambda x, j: x || coalesce(array_to_string(list_transform(list_filter(range({n}), lambda i: i % len(s) = j - 1), lambda i: ' ' || ({many(stimuli.EMOJI)})[i % 8 + 1]), ''), '')), ' '), '')",
    "punctuation": lambda n: f"coalesce(array_to_string(list_transform(s, lambda x, j: CASE WHEN j <= {n} THEN regexp_replace(x, '\\.$', '{'!' * min(n, 3)}') ELSE x END), ' '), '')",
    "hedging": lambda n: f"coalesce(array_to_string(list_transform(s, lambda x, j: CASE WHEN j <= {n} THEN ({many(stimuli.HEDGES)})[(j - 1) % 6 + 1] || ' ' || {_LOW} ELSE x END), ' '), '')",
    "confident": lambda n: f"coalesce(array_to_string(list_transform(s, lambda x, j: CASE WHEN j <= {n} THEN ({many(stimuli.CONFIDENT)})[(j - 1) % 6 + 1] || ', ' || {_LOW} ELSE x END), ' '), '')",
    "bullets": lambda n: "CASE WHEN len(s) = 0 THEN '' ELSE s[1] || chr(10) || coalesce(array_to_string(list_transform(s[2:], lambda x: '- ' || x), chr(10)), '') END" if n == 1 else "coalesce(array_to_string(list_transform(s, lambda x: '- ' || x), chr(10)), '')",
    "headers": lambda n: "'## Answer' || chr(10) || coalesce(array_to_string(s, ' '), '')" if n == 1 else "'## Answer' || chr(10) || coalesce(array_to_string(s[1:greatest(1, len(s) // 2)], ' '), '') || chr(10) || chr(10) || '### Further detail' || chr(10) || coalesce(array_to_string(s[greatest(1, len(s) // 2) + 1:], ' '), '')",
}


def _buzz_sql(n: int) -> str:
    out = "s"
    for i, w in enumerate((stimuli.BUZZWORDS * n)[:n]):
        out = f"list_transform({out}, lambda x, j: CASE WHEN j - 1 = {i} % len(s) THEN {quoted(w[0].upper() + w[1:] + ', ')} || {_LOW} ELSE x END)"
    return f"coalesce(array_to_string({out}, ' '), '')"


_SQL["buzzwords"] = _buzz_sql


def _variants(name: str):
    doses, _ = stimuli.DOSES[name]
    sql = f"WITH {A}, {S}" + " UNION ALL ".join(f" SELECT doc_id, {n} AS dose, {OUT} FROM (SELECT doc_id, {_SQL[name](n)} AS v FROM s)" for n in doses)

    @add(f"b_{name}", sql)
    def run(spark, d):
        a = answers(spark, d).withColumn("s", sentences(F.col("answer")))
        ladder = F.array(*[F.struct(F.lit(n).alias("dose"), stimuli.variant(name, n, F.col("answer"), F.col("s"), F.col("s")).alias("v")) for n in doses])
        return _out(a.select("doc_id", F.inline(ladder)), "doc_id", "dose")


for _name in stimuli.DOSES:
    _variants(_name)

_NULLS = {
    "double_spaces": "replace(answer, '. ', '.  ')", "curly_quotes": "replace(replace(answer, '''', '’'), '\"', '“')", "trailing_space": "answer || ' '", "leading_space": "' ' || answer",
    "nbsp_spaces": "CASE WHEN len(p) <= 4 THEN array_to_string(p, chr(160)) ELSE array_to_string(p[1:3], chr(160)) || chr(160) || array_to_string(p[4:], ' ') END",
}


@add("b15_semantic_nulls", f"WITH {A}, p AS (SELECT *, string_split(answer, ' ') AS p FROM a) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS edit, {OUT} FROM (SELECT doc_id, {v} AS v FROM p)" for k, v in _NULLS.items()))
def b15(spark, d):
    edits = stimuli.semantic_nulls(F.col("answer"))
    x = F.array(*[F.struct(F.lit(k).alias("edit"), edits[k].alias("v")) for k in _NULLS])
    return _out(answers(spark, d).select("doc_id", F.inline(x)), "doc_id", "edit")


@add("b15_nfkd")
def b15_nfkd(spark, d):
    return _out(answers(spark, d).select("doc_id", stimuli.nfkd("answer").alias("v")), "doc_id")


@add("b16_template_swap", """SELECT n_nationkey, t.id AS template_id, c_custkey, replace(t.q, '{name}', c_name) AS question, replace(t.r, '{name}', c_name) AS answer
FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (VALUES (1, 'Is {name} a good fit?', 'Yes, {name} fits well.'), (2, 'Write to {name}.', 'Dear {name}, thank you.')) AS t(id, q, r)""")  # fmt: skip
def b16(spark, d):
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(q).alias("q"), F.lit(r).alias("r")) for i, q, r in ((1, "Is {name} a good fit?", "Yes, {name} fits well."), (2, "Write to {name}.", "Dear {name}, thank you."))])
    x = people.select("n_nationkey", "c_custkey", "c_name", F.inline(t))
    return x.select("n_nationkey", "template_id", "c_custkey", F.replace("q", F.lit("{name}"), F.col("c_name")).alias("question"), F.replace("r", F.lit("{name}"), F.col("c_name")).alias("answer"))


#: A small affix library of our own: id, family, text, positions, the control that it is held against.
AFFIXES = [
    ("official", "authority", "As the official reference states: ", ["prefix", "suffix"], None),
    ("gold", "self_rating", " [Rated 10/10]", ["suffix"], None),
    ("forged_sep", "special_token", " [SEP] {good}", ["prefix", "suffix"], "plain_words"),
    ("plain_words", "lookalike_control", " (section) {good}", ["prefix", "suffix"], None),
    ("neutral_note", "neutral_control", " This line adds nothing.", ["prefix", "suffix"], None),
    ("polite", "politeness", "Thank you for asking. ", ["prefix"], None),
]
AFFIX_SQL = "af AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(i)}, {quoted(f)}, {quoted(t)}, {quoted(p)}, {quoted(c) if c else 'NULL'})" for i, f, t, ps, c in AFFIXES for p in ps) + ") AS v(affix_id, family, affix, position, control_for))"


def affixes(spark):
    """One row per affix and position; its size is that of the library."""
    return spark.createDataFrame([(i, f, t, p, c) for i, f, t, ps, c in AFFIXES for p in ps], "affix_id string, family string, affix string, position string, control_for string")


GRID_SQL = f"{AFFIX_SQL}, g AS (SELECT item_id, affix_id, family, position, control_for, text AS base, CASE WHEN position = 'prefix' THEN replace(affix, '{{good}}', 'Yes.') || text ELSE text || replace(affix, '{{good}}', 'Yes.') END AS v FROM benchmark CROSS JOIN af)"


def grid(spark, d):
    """Every item under every affix and position (the library is a small literal, so it is broadcast)."""
    g = table(spark, d, "benchmark").crossJoin(F.broadcast(affixes(spark)))
    return g.select("item_id", "affix_id", "family", "position", "control_for", F.col("text").alias("base"), stimuli.affixed(F.col("text"), F.col("affix"), F.col("position"), F.lit("Yes.")).alias("v"))


@add("b17_affix_grid", f"WITH {GRID_SQL} SELECT item_id, affix_id, position, {OUT} FROM g")
def b17(spark, d):
    return _out(grid(spark, d), "item_id", "affix_id", "position")


@add("b18_stacked_affix", f"SELECT item_id, {OUT} FROM (SELECT item_id, 'Thank you for asking. ' || text || ' [Rated 10/10]' AS v FROM benchmark)")
def b18(spark, d):
    b = F.col("text")
    for t, p in (("Thank you for asking. ", "prefix"), (" [Rated 10/10]", "suffix")):
        b = stimuli.affixed(b, F.lit(t), F.lit(p), F.lit("Yes."))
    return _out(table(spark, d, "benchmark").select("item_id", b.alias("v")), "item_id")


@add("b20_reference_thresholds", f"""WITH {A}, x AS (SELECT cluster, {WORDS.format('answer')} * 0.01::DOUBLE AS score FROM a)
SELECT cluster, count(*) AS n_refs, count(*) >= 8 AS ref_ok, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.9), 6) AS p90 FROM x GROUP BY cluster""")  # fmt: skip
def b20(spark, d):
    x = answers(spark, d).select("cluster", scoring.length_score(F.col("answer")).alias("score"))
    out = quantiles(x, "score", [0.25, 0.5, 0.75, 0.9], "cluster").select("cluster", F.col("n").alias("n_refs"), F.col("q").alias("p"))
    return out.select("cluster", "n_refs", (F.col("n_refs") >= 8).alias("ref_ok"), *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90"))])


JUNK = [("filler", "This says nothing."), ("rude", "Go away.")]


@add("b21_contamination", "WITH j AS (SELECT * FROM (VALUES ('filler', 'This says nothing.'), ('rude', 'Go away.')) AS v(junk_id, junk)) SELECT item_id, junk_id, place, " + f"{WORDS.format('v')}::BIGINT - {WORDS.format('text')}::BIGINT AS delta_words, sha256(v) AS sha FROM (SELECT item_id, junk_id, text, place, CASE WHEN place = 'before' THEN junk || ' ' || text ELSE text || ' ' || junk END AS v FROM benchmark CROSS JOIN j CROSS JOIN (VALUES ('before'), ('after')) AS w(place))")
def b21(spark, d):
    j = F.array(*[F.struct(F.lit(i).alias("junk_id"), F.lit(t).alias("junk"), F.lit(w).alias("place")) for i, t in JUNK for w in ("before", "after")])
    x = table(spark, d, "benchmark").select("item_id", "text", F.inline(j))
    x = x.withColumn("v", F.when(F.col("place") == "before", F.concat_ws(" ", "junk", "text")).otherwise(F.concat_ws(" ", "text", "junk")))
    return x.select("item_id", "junk_id", "place", (word_count(F.col("v")) - word_count(F.col("text"))).cast("long").alias("delta_words"), digest(F.col("v")).alias("sha"))


_TURN = "CASE role WHEN 'user' THEN chr(10) || chr(10) || 'Human: ' || coalesce(text, '') WHEN 'assistant' THEN chr(10) || chr(10) || 'Assistant: ' || coalesce(text, '') ELSE coalesce(text, '') END"


@add("b22_transcript_parse", rf"""WITH t AS (SELECT conv_id, string_agg({_TURN}, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, t, string_split(t, chr(10) || chr(10) || 'Assistant:') AS parts FROM t),
q AS (SELECT conv_id, {STRIP.format('parts[-1]')} AS response, array_to_string(parts[:-2], chr(10) || chr(10) || 'Assistant:') AS before, len(parts) AS n FROM p),
r AS (SELECT *, {STRIP.format("regexp_replace(string_split(before, chr(10) || chr(10) || 'Human:')[-1], '\\s+', ' ', 'g')")} AS p0 FROM q),
z AS (SELECT *, CASE WHEN starts_with(p0, 'Human:') THEN {STRIP.format('p0[7:]')} ELSE p0 END AS prompt FROM r)
SELECT conv_id, CASE WHEN ok THEN sha256(prompt) END AS prompt_sha, CASE WHEN ok THEN sha256(response) END AS response_sha FROM (SELECT *, n > 1 AND prompt <> '' AND response <> '' AS ok FROM z)""")
def b22(spark, d):
    c = table(spark, d, "conversations")
    said = F.when(F.col("role") == "user", F.concat(F.lit("\n\nHuman: "), F.coalesce("text", F.lit("")))).when(F.col("role") == "assistant", F.concat(F.lit("\n\nAssistant: "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    t = c.select("conv_id", "turn", said.alias("said")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]), "").alias("t"))
    p, r = stimuli.parse_transcript(F.col("t"))
    return t.select("conv_id", digest(p).alias("prompt_sha"), digest(r).alias("response_sha"))


@add("a5_reduce_grid", f"WITH {AFFIX_SQL}, f AS (SELECT family, min(affix_id) AS affix_id FROM af GROUP BY family) SELECT item_id, af.affix_id, af.position FROM benchmark CROSS JOIN af JOIN f USING (family, affix_id) WHERE af.position = 'suffix' OR af.family = 'neutral_control' OR (SELECT count(*) FROM af b WHERE b.affix_id = af.affix_id) = 1")
def a5(spark, d):
    a = affixes(spark)
    n = a.groupBy("affix_id").agg(F.count(F.lit(1)).alias("places"))
    kept = a.join(a.groupBy("family").agg(F.min("affix_id").alias("affix_id")), ["family", "affix_id"]).join(n, "affix_id")
    kept = kept.where((F.col("position") == "suffix") | (F.col("family") == "neutral_control") | (F.col("places") == 1))
    return table(spark, d, "benchmark").crossJoin(F.broadcast(kept)).select("item_id", "affix_id", "position")


@add("c2_score_length", f"WITH {A} SELECT doc_id, round({WORDS.format('answer')} * 0.01::DOUBLE, 6) AS score FROM a")
def c2(spark, d):
    return answers(spark, d).select("doc_id", F.round(scoring.length_score(F.col("answer")), 6).alias("score"))


@add("c4_score_hash_noise", f"WITH {A} SELECT doc_id, round(({U.format("'7:' || question || ':' || answer")} - 0.5) * 2 * 0.1, 8) AS noise FROM a")
def c4(spark, d):
    return answers(spark, d).select("doc_id", F.round(scoring.noise(F.col("question"), F.col("answer")), 8).alias("noise"))


@add("c7_token_measure", f"WITH {GRID_SQL} SELECT item_id, affix_id, position, {WORDS.format('v')}::BIGINT AS n_answer_tokens, {WORDS.format('v')}::BIGINT + 4 AS n_tokens, {WORDS.format('v')} + 4 > 512 AS truncated, greatest(0, (length(v) - length(replace(v, '[SEP]', ''))) // 5 - (length(base) - length(replace(base, '[SEP]', ''))) // 5)::BIGINT AS n_sep, len(regexp_extract_all(v, '\ufffd'))::BIGINT AS n_unknown FROM g")
def c7(spark, d):
    m = scoring.measured(F.lit("q"), F.col("v"), plain=F.col("base"))
    return grid(spark, d).select("item_id", "affix_id", "position", m["n_answer_tokens"].cast("long").alias("n_answer_tokens"), m["n_tokens"].cast("long").alias("n_tokens"), m["truncated"].alias("truncated"), m["n_sep_in_answer"].cast("long").alias("n_sep"), m["n_unknown"].cast("long").alias("n_unknown"))


#: What JSON writes for a text: quoted, with escapes as the key's writer makes them.
JSON = "to_json({0})"
KEY = "sha256('[\"length\",\"1\",\"bare\",\"512\",\"false\",\"q\",' || " + JSON.format("answer") + " || ']')"


@add("c8_cache_anti_join", f"WITH {A}, k AS (SELECT doc_id, {KEY} AS key, answer FROM a), cache AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0) SELECT key, round({WORDS.format('any_value(answer)')} * 0.01::DOUBLE, 6) AS score, count(*) AS asked FROM k ANTI JOIN cache USING (key) GROUP BY key")
def c8(spark, d):
    k = answers(spark, d).select("doc_id", scoring.cache_key(F.lit("q"), F.col("answer")).alias("key"), F.round(scoring.length_score(F.col("answer")), 6).alias("score"))
    cache = k.where("doc_id % 2 = 0").select("key")
    return k.join(cache, "key", "left_anti").groupBy("key").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("asked"))


@add("c12_work_estimate", f"WITH {A}, k AS (SELECT lang, doc_id, {KEY} AS key FROM a) SELECT lang, count(DISTINCT key) AS texts, count(DISTINCT CASE WHEN key NOT IN (SELECT key FROM k WHERE doc_id % 2 = 0) THEN key END) AS to_score FROM k GROUP BY lang")
def c12(spark, d):
    k = answers(spark, d).select("lang", "doc_id", scoring.cache_key(F.lit("q"), F.col("answer")).alias("key"))
    cached = k.groupBy("key").agg(F.max((F.col("doc_id") % 2 == 0).cast("int")).alias("hit"))
    x = k.select("lang", "key").distinct().join(cached, "key")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum(1 - F.col("hit")).cast("long").alias("to_score"))


@add("a9_cache_upsert", "SELECT conv_id AS key, max(turn) AS version, sha256(arg_max(coalesce(text, ''), turn)) AS sha FROM conversations GROUP BY conv_id")
def a9(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("version"), digest(F.coalesce("text", F.lit(""))).alias("sha"))
    return upsert(c.where("version < 2"), c.where("version >= 2"), "key", "version")


@add("a10_cache_key", f"SELECT conv_id, turn, sha256('[\"length\",\"1\",\"bare\",\"512\",\"false\",' || coalesce({JSON.format('role')}, 'null') || ',' || coalesce({JSON.format('text')}, 'null') || ']') AS key FROM conversations")
def a10(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", scoring.cache_key(F.col("role"), F.col("text")).alias("key"))
