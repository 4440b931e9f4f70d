"""Text, chat, feedback, session and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.functions import text as tx
from lodestone.operators import chat, chunking, claims, guardrails, prompts
from lodestone.plans.answering import REFUSE_SQL
from lodestone.plans.registry import query, table, values
from lodestone.plans.retrieval import OVER, TOK, WITHOUT, W
from lodestone.sources import files, store
from lodestone.sources.work import work_dir
from lodestone.streaming import state

any_sql = lambda c, words: "(" + " OR ".join(f"contains({c}, {values([w])})" for w in words) + ")"
starts_sql = lambda c, words: "(" + " OR ".join(f"starts_with({c}, {values([w])})" for w in words) + ")"


# --- Intents and text ---------------------------------------------------------------------------------------------


@query(f"""SELECT conv_id, turn, {any_sql('l', tx.SUMMARY_WORDS)} AS summary, {any_sql('l', tx.VISUAL_WORDS)} AS visual, {any_sql('l', tx.EXPLICIT_VISUAL)} AS explicit_visual, {any_sql('l', tx.NO_DIAGRAM)} AS no_diagram,
{starts_sql('l', tx.CONCEPTUAL)} AS conceptual, regexp_replace(trim(l), '[?!.]+$', '') IN ({values(tx.GREETINGS)}) AS greeting, {REFUSE_SQL('text')} AS refusal FROM (SELECT *, lower(text) AS l FROM conversations)""")
def intent_flags(spark: SparkSession, sf: str) -> DataFrame:
    c, low = table(spark, sf, "conversations"), F.lower("text")
    return c.select(
        "conv_id", "turn", tx.any_of(low, tx.SUMMARY_WORDS).alias("summary"), tx.any_of(low, tx.VISUAL_WORDS).alias("visual"), tx.any_of(low, tx.EXPLICIT_VISUAL).alias("explicit_visual"),
        tx.any_of(low, tx.NO_DIAGRAM).alias("no_diagram"), tx.starts_any(low, tx.CONCEPTUAL).alias("conceptual"), tx.greeting(F.col("text")).alias("greeting"), tx.refusal(F.col("text")).alias("refusal"),
    )


@query(f"""WITH q AS (SELECT item_id, trim(text) AS c, regexp_replace(lower(trim(text)), '[?!.]+$', '') AS l FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Summarize ' || text WHEN 1 THEN 'Show the chart of ' || text ELSE text END AS text FROM benchmark))
SELECT item_id, CASE WHEN length(c) = 0 THEN c WHEN {any_sql('l', tx.SUMMARY_WORDS)} THEN c || ' document summary overview abstract introduction key findings conclusions main contributions'
WHEN {any_sql('l', tx.VISUAL_WORDS)} THEN c || ' figure diagram plot chart architecture workflow illustration scene details' ELSE c END AS search_query FROM q""")
def query_expand(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("item_id") % 3
    q = F.when(r == 0, F.concat(F.lit("Summarize "), "text")).when(r == 1, F.concat(F.lit("Show the chart of "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", prompts.expand_query(q).alias("search_query"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 7 = 0 OR {any_sql('lower(text)', prompts.DIAGRAM_REQUEST)} THEN 'vision-7b' WHEN contains(lower(text), 'table') OR len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: length(w) > 0)) > 15 THEN 'instruct-14b' ELSE 'default-14b' END AS model FROM conversations""")
def model_route(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", prompts.route_model(F.col("text"), F.contains(F.lower("text"), F.lit("table")), F.col("turn") % 7 == 0).alias("model"))


@query(f"""WITH t AS (SELECT conv_id, turn, translate(trim(text), chr(13) || chr(10), '  ') AS c FROM conversations WHERE role = 'user'),
d AS (SELECT conv_id, turn, CASE {' '.join(f"WHEN starts_with(lower(c), {values([p])}) THEN trim(substr(c, {len(p) + 1}))" for p in tx.TITLE_LEADS)} ELSE c END AS d FROM t),
s AS (SELECT conv_id, turn, CASE WHEN length(d) > 48 THEN rtrim(d[1:45]) || '...' ELSE d END AS s FROM d)
SELECT conv_id, turn, CASE WHEN length(s) = 0 THEN 'New Chat' ELSE upper(s[1:1]) || s[2:] END AS title FROM s""")
def smart_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", tx.smart_title(F.col("text")).alias("title"))


def _sanitise_sql(c: str) -> str:
    for pattern, by in tx.SANITISE:
        by = "'' || chr(10) || chr(10)" if by == "\n\n" else values([by])
        c = f"regexp_replace({c}, {values([pattern])}, {by}, 'g')"
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_ANSWER = "CASE turn % 3 WHEN 0 THEN 'Unfortunately, I am unable to display images directly here. ' || text WHEN 1 THEN text || ' The image URL is /api/sessions/s1/images/f.png. Done .' ELSE text END"


@query(f"SELECT conv_id, turn, {_sanitise_sql(_ANSWER)} AS clean FROM conversations WHERE role = 'assistant'")
def response_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", tx.sanitise(F.expr(_ANSWER)).alias("clean"))


@query("SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS doc_key, md5(text) AS md5, regexp_replace(source || '.v1 ü', '[^\\p{L}\\p{N}]', '_', 'g') AS slug FROM documents")
def hashes_and_slug(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha2("text", 256), 1, 16).alias("doc_key"), F.md5(F.col("text").cast("binary")).alias("md5"), tx.slug(F.concat("source", F.lit(".v1 ü"))).alias("slug"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS excerpt FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.approximate_tokens(F.col("text")).alias("tokens"), tx.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT page_id, len(u) AS n_urls, array_to_string(u, ' ') AS urls FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS u FROM pages)")
def url_tag_extract(spark: SparkSession, sf: str) -> DataFrame:
    u = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(u).cast("long").alias("n_urls"), F.array_join(u, " ").alias("urls"))


@query("SELECT r.r_regionkey AS region, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation n JOIN region r ON n_regionkey = r_regionkey GROUP BY r.r_regionkey")
def markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return prompts.markdown_rows(n, "region", "key", ["name", "key"])


@query("SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS position, unnest(w) AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant')")
def answer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return state.words_of(c).withColumn("position", F.col("position").cast("long"))


# --- Claims and grounding -----------------------------------------------------------------------------------------

CLAIM_SQL = f"""a AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[*#_`\\[\\]]', '', 'g') AS p FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20 AND NOT {starts_sql('lower(x)', claims.FILLERS)}) AS ss FROM a),
c AS (SELECT conv_id, turn, list_filter(list_transform(flatten(list_transform(ss, lambda x: string_split(regexp_replace(x, ',\\s*(?:and|but|while|whereas|because)\\s+', chr(1), 'g'), chr(1)))), lambda x: trim(x)), lambda x: length(x) > 15)[1:12] AS cs FROM s),
claim AS (SELECT conv_id, turn, generate_subscripts(cs, 1) - 1 AS claim_no, unnest(cs) AS claim FROM c),
ctx AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS ctx FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
tk AS (SELECT *, list_filter({TOK.format('claim')}, lambda w: length(w) > 3 OR regexp_matches(w, '^[0-9]+$')) AS toks FROM claim LEFT JOIN ctx USING (conv_id)),
ver AS (SELECT conv_id, turn, claim_no, claim, {OVER('toks', "coalesce(ctx, '')")}::DOUBLE / len(toks) AS ratio FROM tk WHERE len(toks) > 0)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims.claims(table(spark, sf, "conversations").where("role = 'assistant'"), ["conv_id", "turn"], "text")


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of assistant turns against the other turns of the conversation."""
    other = table(spark, sf, "conversations").where("role <> 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    ctx = other.select("conv_id", F.lower(F.array_join(F.transform("c", lambda x: x["text"]), " ")).alias("ctx"))
    return claims.verified_claims(_claims(spark, sf).join(ctx, "conv_id", "left").withColumn("ctx", F.coalesce("ctx", F.lit(""))), "ctx")


@query(f"WITH {CLAIM_SQL} SELECT conv_id, turn, claim_no, claim FROM claim")
def claims_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf).withColumn("claim_no", F.col("claim_no").cast("long"))


@query(f"WITH {CLAIM_SQL} SELECT conv_id, turn, claim_no, round(ratio, 6) AS ratio, ratio >= 0.6 AS is_entailed, round(least(1.0, ratio * 1.15), 6) AS prob FROM ver")
def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select("conv_id", "turn", F.col("claim_no").cast("long").alias("claim_no"), "ratio", "is_entailed", "prob")


@query(f"WITH {CLAIM_SQL} SELECT t.conv_id, t.turn, count(v.claim_no) AS total_claims, coalesce(sum((ratio >= 0.6)::INT), 0)::BIGINT AS supported_claims, round(CASE WHEN count(v.claim_no) > 0 THEN sum((ratio >= 0.6)::INT)::DOUBLE / count(v.claim_no) ELSE 1.0 END, 3) AS faithfulness FROM conversations t LEFT JOIN ver v ON v.conv_id = t.conv_id AND v.turn = t.turn WHERE t.role = 'assistant' GROUP BY t.conv_id, t.turn")
def claim_faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    return claims.faithfulness(_verified(spark, sf), table(spark, sf, "conversations").where("role = 'assistant'"), ["conv_id", "turn"])


@query(f"""WITH a AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, lower(text) AS t, 0.30 + 0.05 * (turn % 10) AS score FROM conversations),
x AS (SELECT conv_id, string_agg(t, ' ' ORDER BY rank) AS ctx, round(avg(score) FILTER (rank <= 3), 8)::DOUBLE AS top, count(*) AS n FROM c GROUP BY conv_id),
w AS (SELECT a.*, ctx, top, n, {WITHOUT(W('question'), tx.STOP_GROUNDING)} AS ws FROM a LEFT JOIN x USING (conv_id)),
l AS (SELECT *, CASE WHEN len(ws) = 0 THEN 1 ELSE {OVER('ws', 'ctx')} END AS lex, n IS NULL OR length(coalesce(answer, '')) = 0 OR {REFUSE_SQL('answer')} AS none FROM w),
f AS (SELECT *, round(CASE WHEN top < 0.38 AND NOT lex > 0 THEN 0.0 WHEN lex > 0 THEN least(1.0, greatest(0.0, least(1.0, (top - 0.38) / 0.47)) + 0.15) ELSE greatest(0.0, least(1.0, (top - 0.38) / 0.47)) END, 4)::DOUBLE AS conf FROM l)
SELECT conv_id, coalesce(NOT none AND NOT (conf < 0.2 AND lex = 0 AND len(ws) > 0), false) AS is_grounded, CASE WHEN none THEN 0.0 ELSE conf END::DOUBLE AS confidence, CASE WHEN none OR (conf < 0.2 AND lex = 0 AND len(ws) > 0) THEN 0 ELSE n END::BIGINT AS n_citations FROM f""")
def grounding_eval(spark: SparkSession, sf: str) -> DataFrame:
    """First question and last answer of a conversation against all its turns."""
    c = table(spark, sf, "conversations")
    a = c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))
    chunks = c.select("conv_id", "text", (0.30 + 0.05 * (F.col("turn") % 10)).alias("score"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"))
    return guardrails.grounding(a, chunks, key="conv_id", question="question", answer="answer", text="text", score="score", rank="rank")


# --- Chat store ---------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The conversations table as a chat store: a turn's number stands for its time."""
    c = table(spark, sf, "conversations")
    convs = c.groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("s"), F.col("conv_id") % 5).alias("session_id"), F.lit("New Chat").alias("title"), F.min("turn").cast("double").alias("created_at"), F.max("turn").cast("double").alias("updated_at"))
    return convs, c.select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, "no json").otherwise(F.concat(F.lit('{"turn": "'), F.col("turn"), F.lit('"}'))).alias("grounding_metadata"), F.col("turn").cast("double").alias("created_at"))


@query("SELECT conv_id AS id, 's' || (conv_id % 5) AS session_id, count(*) AS message_count, max(turn)::DOUBLE AS updated_at FROM conversations GROUP BY conv_id")
def conversation_list(spark: SparkSession, sf: str) -> DataFrame:
    convs, msgs = _store(spark, sf)
    return chat.list_conversations(convs, msgs).select("id", "session_id", "message_count", "updated_at")


@query("SELECT conv_id AS conversation_id, count(*) AS message_count, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS transcript, string_agg(CASE WHEN turn % 3 = 0 THEN '-' ELSE turn::VARCHAR END, ',' ORDER BY turn) AS metadata FROM conversations GROUP BY conv_id")
def conversation_detail(spark: SparkSession, sf: str) -> DataFrame:
    d = chat.conversation_detail(_store(spark, sf)[1])
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    meta = F.array_join(F.transform("messages", lambda m: F.coalesce(m["grounding_metadata"]["turn"], F.lit("-"))), ",")
    return d.select("conversation_id", "message_count", F.md5(text.cast("binary")).alias("transcript"), meta.alias("metadata"))


@query("""SELECT conv_id AS id, 's' || (conv_id % 5) AS session_id, 'New Chat' AS title, max(turn)::DOUBLE AS updated_at FROM conversations GROUP BY conv_id
UNION ALL SELECT 1000000 + item_id, 's9', CASE WHEN item_id % 3 = 0 THEN 'New Chat' ELSE trim(text)[1:60] END, 7.0 FROM benchmark""")
def chat_create(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations for the benchmark's questions, which become their titles; every third has a blank one."""
    title = F.when(F.col("item_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.trim("text"), F.lit(" ")))
    new = table(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000).alias("id"), F.lit("s9").alias("session_id"), title.alias("title"))
    return chat.create(_store(spark, sf)[0], new, F.lit(7.0)).select("id", "session_id", "title", "updated_at")


@query("SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'Renamed ' || conv_id ELSE 'New Chat' END AS title, CASE WHEN conv_id % 3 = 0 THEN 999.0 ELSE max(turn) END::DOUBLE AS updated_at FROM conversations GROUP BY conv_id")
def chat_update(spark: SparkSession, sf: str) -> DataFrame:
    convs, _ = _store(spark, sf)
    titles = convs.where(F.col("id") % 3 == 0).select("id", F.concat(F.lit("  Renamed "), "id").alias("new_title"))
    return chat.rename(convs, titles, F.lit(999.0)).select("id", "title", "updated_at")


@query("SELECT conv_id AS conversation_id, count(*) AS n FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id")
def chat_delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    convs, msgs = _store(spark, sf)
    left, rest = chat.delete(convs, msgs, convs.where(F.col("id") % 4 == 0).select("id"))
    return rest.join(left.select(F.col("id").alias("conversation_id")), "conversation_id").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 500.0 ELSE max(turn) END::DOUBLE AS updated_at, count(*) + (conv_id % 2 = 0)::INT AS messages FROM conversations GROUP BY conv_id")
def chat_insert(spark: SparkSession, sf: str) -> DataFrame:
    convs, msgs = _store(spark, sf)
    new = convs.where(F.col("id") % 2 == 0).select(F.concat(F.lit("n"), "id").alias("id"), F.col("id").alias("conversation_id"), F.lit("user").alias("role"), F.lit("more").alias("content"), F.lit(None).cast("string").alias("grounding_metadata"), F.lit(500.0).alias("created_at"))
    convs2, msgs2 = chat.add_messages(convs, msgs, new)
    n = msgs2.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("messages"))
    return convs2.join(n, "id").select("id", "updated_at", "messages")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), v AS (SELECT * FROM (VALUES (2), (4), (10), (12)) v(cap))
SELECT cap, conv_id, turn, row_number() OVER (PARTITION BY cap, conv_id ORDER BY turn)::INTEGER AS position FROM r, v WHERE rn <= cap""")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    out = None
    for cap in (2, 4, 10, 12):
        w = chat.last_turns(c, "conv_id", "turn", cap).select(F.lit(cap).alias("cap"), "conv_id", "turn", "position")
        out = w if out is None else out.unionByName(w)
    return out


# --- Feedback -----------------------------------------------------------------------------------------------------


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as ratings of documents: quality 1 approves, the document's source is the citation."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    return j.select(F.col("doc_id").alias("feedback_id"), F.col("text").alias("query"), F.col("text").alias("answer"), F.when(F.col("quality") == 1, "thumbs_up").otherwise("thumbs_down").alias("rating"), F.array("source").alias("citations"))


@query("SELECT source AS source_file, round(sum(CASE WHEN quality = 1 THEN 0.12 ELSE -0.15 END), 3)::DOUBLE AS boost FROM labels JOIN documents USING (doc_id) GROUP BY source")
def feedback_boosts(spark: SparkSession, sf: str) -> DataFrame:
    return chat.citation_boosts(_feedback(spark, sf))


@query("""WITH b AS (SELECT source, round(sum(CASE WHEN quality = 1 THEN 0.12 ELSE -0.15 END), 3)::DOUBLE AS boost FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT doc_id, round(CASE WHEN coalesce(boost, 0) <> 0 THEN greatest(0.0, least(1.0, (doc_id % 10) / 10.0 + boost)) ELSE (doc_id % 10) / 10.0 END, 6) AS score FROM documents LEFT JOIN b USING (source)""")
def boosted_scores(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_file"), (F.col("doc_id") % 10 / 10.0).alias("score"))
    return chat.boosted(chunks, chat.citation_boosts(_feedback(spark, sf))).select("doc_id", F.round("score", 6).alias("score"))


_EX = lambda rating, words, top: f"""WITH q AS (SELECT item_id, unnest({words}) AS w FROM benchmark),
r AS (SELECT doc_id AS feedback_id, lower(trim(text)) AS low FROM labels JOIN documents USING (doc_id) WHERE quality {rating}),
h AS (SELECT item_id, feedback_id, count(*) AS overlap FROM q JOIN r ON contains(low, w) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, feedback_id)::INTEGER AS rank FROM h) SELECT * FROM k WHERE rank <= {top}"""  # noqa: E731


@query(_EX("= 1", WITHOUT(W("text"), tx.STOP_EXEMPLAR), 2))
def feedback_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    return chat.exemplars(table(spark, sf, "benchmark"), _feedback(spark, sf), query="item_id", question="text", rating="thumbs_up", top=2, stop=tx.STOP_EXEMPLAR)


@query(_EX("<> 1", W("text"), 1))
def feedback_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return chat.exemplars(table(spark, sf, "benchmark"), _feedback(spark, sf), query="item_id", question="text", rating="thumbs_down", top=1)


@query("SELECT CASE WHEN quality = 1 THEN 'thumbs_up' ELSE 'thumbs_down' END AS rating, count(*) AS n, sum(length(text))::BIGINT AS query_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def feedback_export(spark: SparkSession, sf: str) -> DataFrame:
    return _feedback(spark, sf).groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("query")).alias("query_chars"))


@query("SELECT doc_id AS feedback_id, text AS query, CASE WHEN quality = 1 THEN 'thumbs_up' ELSE 'thumbs_down' END AS rating, source AS cited FROM labels JOIN documents USING (doc_id)")
def feedback_export_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The exported rows themselves: written as JSON lines and read back as feedback."""
    path, e = work_dir(spark), _feedback(spark, sf)
    entries = e.select("query", "answer", "rating", F.lit("none").alias("model"), "citations", F.col("feedback_id").cast("double").alias("timestamp"))
    store.write_feedback(entries, f"{path}/session", f"{path}/global")
    back = store.read_feedback(spark, f"{path}/session", f"{path}/global")
    return back.select(F.col("timestamp").cast("long").alias("feedback_id"), "query", "rating", F.col("citations")[0].alias("cited"))


# --- Sessions and progress ----------------------------------------------------------------------------------------



def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", F.unix_timestamp(F.date_trunc("second", "ts")).alias("at"))
    return e.groupBy(F.col("user_id").alias("session_id")).agg(F.array_sort(F.collect_set("event_type")).alias("files"), F.max("at").alias("modified_at"), (F.max("at") + F.first("user_id") % 9 * 86400).alias("expires_at"))


def _with_now(spark: SparkSession, sf: str, s: DataFrame) -> DataFrame:
    now = table(spark, sf, "events").agg((F.max(F.unix_timestamp(F.date_trunc("second", "ts"))) + 86400 * 4).alias("now"))
    return s.crossJoin(F.broadcast(now))  # one row


@query("WITH ses AS (SELECT user_id AS session_id, max(floor(epoch(ts)))::BIGINT AS modified_at, max(floor(epoch(ts)))::BIGINT + user_id % 9 * 86400 AS expires_at FROM events GROUP BY user_id), cut AS (SELECT max(floor(epoch(ts)))::BIGINT + 86400 * 4 AS now FROM events) SELECT session_id, expires_at FROM ses, cut WHERE expires_at >= now")
def session_active(spark: SparkSession, sf: str) -> DataFrame:
    return chat.active(_with_now(spark, sf, _sessions(spark, sf)), F.col("now")).select("session_id", "expires_at")


@query("WITH ses AS (SELECT user_id AS session_id, list_sort(list_distinct(list(event_type))) AS files, max(floor(epoch(ts)))::BIGINT AS modified_at FROM events GROUP BY user_id), g AS (SELECT array_to_string(files, '::') AS signature, arg_max(struct_pack(session_id := session_id, modified_at := modified_at), struct_pack(m := modified_at, s := session_id)) AS s FROM ses WHERE len(files) > 0 GROUP BY 1) SELECT s.session_id AS session_id, s.modified_at AS modified_at, signature FROM g ORDER BY s.modified_at DESC, s.session_id DESC LIMIT 8")
def session_list(spark: SparkSession, sf: str) -> DataFrame:
    return chat.list_sessions(_sessions(spark, sf)).select("session_id", "modified_at", "signature")


@query("WITH ses AS (SELECT user_id AS session_id, list_sort(list_distinct(list(event_type))) AS files FROM events GROUP BY user_id) SELECT session_id, array_to_string(list_concat(files, CASE WHEN session_id % 2 = 0 THEN list_filter(['click', 'zz.pdf'], lambda f: NOT list_contains(files, f)) ELSE [] END), ',') AS files FROM ses")
def files_union(spark: SparkSession, sf: str) -> DataFrame:
    s = _sessions(spark, sf)
    new = s.where(F.col("session_id") % 2 == 0).select("session_id", F.array(F.lit("click"), F.lit("zz.pdf")).alias("new_files"))
    return chat.add_files(s, new).select("session_id", F.array_join("files", ",").alias("files"))


@query("SELECT user_id AS session_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS stage, max(event_id) % 40 AS current, least(100.0, round(100.0 * (max(event_id) % 40) / greatest(1, max(event_id) % 7 * 10), 1))::DOUBLE AS percent FROM events GROUP BY user_id")
def progress_last(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("event_id").alias("m"))
    return e.select("session_id", "stage", (F.col("m") % 40).alias("current"), sc.progress_percent(F.col("m") % 40, F.col("m") % 7 * 10).alias("percent"))


@query("SELECT user_id AS key, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, max(struct_pack(t := ts, e := event_id)).e AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest(table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_type", "event_id", "ts"), "key", ["ts", "event_id"]).select("key", "event_type", "event_id")


@query("SELECT user_id AS key, max(CASE WHEN event_id % 2 = 0 THEN event_id END) AS new_id, coalesce(max(CASE WHEN event_id % 2 = 0 THEN event_id END), max(event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    old = e.where("event_id % 2 = 1").groupBy(F.col("user_id").alias("key")).agg(F.lit(None).cast("long").alias("new_id"), F.max("event_id").alias("event_id"))
    new = e.where("event_id % 2 = 0").select(F.col("user_id").alias("key"), F.col("event_id").alias("new_id"), "event_id")  # keys repeat
    return store.upsert(old, new, "key")


@query("SELECT event_id, 'kind=' || event_type || ';tags=' || event_type || ', x' AS meta FROM events")
def metadata_coerce(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    raw = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("none"), F.lit(None).cast("string"), F.lit("tags"), F.to_json(F.array("event_type", F.lit("x"))))
    m = e.select("event_id", store.coerce_metadata(raw).alias("m"))
    return m.select("event_id", F.concat(F.lit("kind="), F.col("m")["kind"], F.lit(";tags="), F.col("m")["tags"]).alias("meta"))


# --- Sources ------------------------------------------------------------------------------------------------------

_PATH = "'/in/f' || doc_id || (CASE doc_id % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' WHEN 3 THEN '.Png' WHEN 4 THEN '.xyz' ELSE '.md' END)"


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' WHEN 3 THEN 'image' ELSE 'text' END AS parser, lower(regexp_extract({_PATH}, '(\\.[^./]+)$', 1)) AS ext FROM documents")
def source_router(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    return d.select("doc_id", files.route(F.col("path")).alias("parser"), files.extension(F.col("path")).alias("ext"))


LINES = "CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END"


@query(f"SELECT doc_id, {LINES}::BIGINT AS n_lines, greatest(1, ceil(length(text) / 3000.0), ceil({LINES} / 55.0))::INTEGER AS pages FROM documents")
def page_estimate(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", files.line_count(t).cast("long").alias("n_lines"), files.page_estimate(t).alias("pages"))


@query("""WITH d AS (SELECT doc_id, replace(text, ' ', chr(10)) AS text FROM documents), p AS (SELECT *, string_split(text, chr(10)) AS l, greatest(1, ceil(length(text) / 3000.0), ceil(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) / 55.0))::INT AS total FROM d)
SELECT doc_id, md5(regexp_replace(CASE WHEN 2 > least(total, 3) THEN array_to_string(l[1:total * 55], chr(10)) WHEN 55 < len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) THEN array_to_string(l[56:55 * least(total, 3)], chr(10)) ELSE text END, '^\\s+|\\s+$', '', 'g')) AS slice FROM p""")
def page_slice(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("text"))
    return d.select("doc_id", F.md5(files.page_slice(F.col("text"), 2, 3).cast("binary")).alias("slice"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS s, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 0)) AS w FROM documents), t AS (SELECT *, greatest(1, ceil(w / 450.0), ceil(len(s) / 15.0))::INT AS total FROM d)
SELECT doc_id, total AS pages, md5(array_to_string(s[floor(1.0 / total * len(s))::INT + 1:least(len(s), ceil(2.0 / total * len(s))::INT)], chr(10))) AS slice FROM t""")
def section_slice(spark: SparkSession, sf: str) -> DataFrame:
    s = F.split("text", "\n", -1)
    w = F.size(F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 0))
    d = table(spark, sf, "documents").select("doc_id", s.alias("s"), files.section_pages(w, F.size(s)).alias("pages"))
    return d.select("doc_id", "pages", F.md5(F.array_join(files.section_slice(F.col("s"), F.col("pages"), F.lit(2), F.lit(2)), "\n").cast("binary")).alias("slice"))


@query(f"""WITH d AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'png' WHEN 2 THEN 'mp4' WHEN 3 THEN 'docx' ELSE 'bin' END AS e, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, CASE e WHEN 'png' THEN 1 WHEN 'txt' THEN greatest(1, ceil(length(text) / 3000.0), ceil({LINES} / 55.0)) WHEN 'docx' THEN greatest(1, round(n / 25000.0)) ELSE greatest(1, round(n / 3000.0)) END::INTEGER AS pages, e = 'png' AS is_image, CASE e WHEN 'png' THEN 'image' ELSE e END AS file_type, e = 'mp4' AS rejected FROM d""")
def document_inspect(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.expr("CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'png' WHEN 2 THEN 'mp4' WHEN 3 THEN 'docx' ELSE 'bin' END")
    d = table(spark, sf, "documents").select(F.concat("doc_id", F.lit("."), ext).alias("filename"), F.col("text").cast("binary").alias("content"))
    return files.inspect(d).select(F.split_part("filename", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), "pages", "is_image", "file_type", "rejected")


# --- Chunking -----------------------------------------------------------------------------------------------------


@query()
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"), "text")
    return chunking.recursive_chunks(d)


@query()
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return recursive_chunks(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("chars"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as nodes: short ones are headers, thirty to a page."""
    kinds = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.when(F.length(x) < 12, "header").otherwise("paragraph").alias("type"), x.alias("content"), (F.floor(i / 30) + 1).cast("int").alias("page")))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Document: "), "doc_id").alias("title"), kinds.alias("nodes"))


@query()
def parent_child_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.parent_child_chunks(_nodes(spark, sf)).drop("full_content", "pages")


@query("""WITH n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, i AS node, coalesce(last_value(CASE WHEN length(c) < 12 THEN trim(c) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'Document: ' || doc_id) AS section_title FROM n""")
def section_titles(spark: SparkSession, sf: str) -> DataFrame:
    n = _nodes(spark, sf).select("doc_id", "title", F.posexplode("nodes").alias("node", "x")).select("doc_id", "title", (F.col("node") + 1).cast("long").alias("node"), "x.type", "x.content")
    return chunking.section_titles(n, "doc_id", "node", "type", "content", "title").select("doc_id", "node", "section_title")




SES = "ses AS (SELECT user_id AS session_id, max(floor(epoch(ts)))::BIGINT AS modified_at, max(floor(epoch(ts)))::BIGINT + user_id % 9 * 86400 AS expires_at FROM events GROUP BY user_id), cut AS (SELECT max(floor(epoch(ts)))::BIGINT + 86400 * 4 AS now FROM events)"


@query(f"WITH {SES} SELECT session_id, modified_at, expires_at FROM ses UNION ALL SELECT c_custkey + 1000000, 7, 7 + 24 * 3600 FROM customer")
def session_create(spark: SparkSession, sf: str) -> DataFrame:
    """Customers open new sessions; ids of old sessions are asked for too and keep theirs."""
    old = _sessions(spark, sf)
    new = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("session_id")).unionByName(old.select("session_id")).withColumn("token", F.col("session_id").cast("string"))
    return chat.create_session(old, new, F.lit(7).cast("long")).select("session_id", "modified_at", "expires_at")


@query(f"WITH {SES} SELECT session_id, expires_at, session_id % 2 = 0 AS live FROM ses, cut WHERE session_id % 2 <> 0 OR expires_at >= now")
def session_rehydrate(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions after those with even ids were asked for; live marks the ones that came back."""
    s = _with_now(spark, sf, _sessions(spark, sf))
    live, left = chat.rehydrate(s, s.where("session_id % 2 = 0"), F.col("now"))
    return left.join(live.select("session_id", F.lit(True).alias("live")), "session_id", "left").select("session_id", "expires_at", F.coalesce("live", F.lit(False)).alias("live"))


@query(f"WITH {SES} SELECT session_id, modified_at FROM ses WHERE session_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def session_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("session_id"))
    return chat.delete_sessions(_sessions(spark, sf), gone).select("session_id", "modified_at")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE contains(lower(text), 'the') AND turn = 0)")
def memory_reset(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return chat.reset_memory(c, c.where("contains(lower(text), 'the') AND turn = 0"), "conv_id").select("conv_id", "turn")
