"""Chat store, sessions and feedback as table operators; an update gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def list_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their message count (0 without messages), those updated last first."""
    n = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"))
    return conversations.join(n, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0))).orderBy(F.desc("updated_at"), "id")


def conversation_detail(messages: DataFrame, metadata_schema: str = "map<string,string>") -> DataFrame:
    """(conversation_id, message_count, messages in time order, each with its decoded metadata); metadata that isn't JSON is null."""
    raw = F.col("grounding_metadata") if "grounding_metadata" in messages.columns else F.lit(None).cast("string")
    m = messages.select("conversation_id", F.struct("created_at", "role", "content", raw.alias("raw")).alias("m"))
    # Sorted as text, decoded after: maps have no order.
    decoded = lambda x: F.struct(x["created_at"].alias("created_at"), x["role"].alias("role"), x["content"].alias("content"), F.from_json(x["raw"], metadata_schema).alias("grounding_metadata"))
    return m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"), F.transform(F.sort_array(F.collect_list("m")), decoded).alias("messages"))


def create(conversations: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """conversations with new ones (id, session_id, title) added: titles trimmed and cut at 60, "New Chat" when blank or missing."""
    clean = F.substring(F.trim(F.coalesce("title", F.lit(""))), 1, 60)
    rows = new.select("id", "session_id", F.when(F.length(clean) == 0, "New Chat").otherwise(clean).alias("title"), now.alias("created_at"), now.alias("updated_at"))
    return conversations.unionByName(rows, allowMissingColumns=True)


def rename(conversations: DataFrame, titles: DataFrame, now: Column) -> DataFrame:
    """Titles (id, new_title) applied: trimmed, cut at 60, "New Chat" when blank; touched ones get updated_at."""
    clean = F.substring(F.trim("new_title"), 1, 60)
    out = conversations.join(titles, "id", "left")
    hit = F.col("new_title").isNotNull()
    return out.withColumns({"title": F.when(hit, F.when(F.length(clean) == 0, "New Chat").otherwise(clean)).otherwise(F.col("title")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("new_title")


def delete(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations of ids (id) and their messages."""
    return conversations.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


def add_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages appended and their conversations touched with the latest time."""
    latest = new.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("_at"))
    touched = conversations.join(latest, "id", "left").withColumn("updated_at", F.coalesce("_at", "updated_at")).drop("_at")
    return touched, messages.unionByName(new, allowMissingColumns=True)


def last_turns(turns: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n turns of each conversation, in order, numbered by position."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    kept = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def history_text(turns: DataFrame, key: str, order: str, content: str, n: int = 2) -> DataFrame:
    """(key, history): the text of the last n turns in one string."""
    last = last_turns(turns, key, order, n)
    return last.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", content))), lambda x: x[content]), "\n").alias("history"))


def reset_memory(turns: DataFrame, cleared: DataFrame, key: str) -> DataFrame:
    """turns without those of the conversations in cleared."""
    return turns.join(cleared.select(key).distinct(), key, "left_anti")


# --- Feedback -----------------------------------------------------------------------------------------------------


def citation_boosts(feedback: DataFrame, citations: str = "citations") -> DataFrame:
    """(source_file, boost): +.12 for each approval, -.15 for any other rating."""
    delta = F.when(F.col("rating") == "thumbs_up", 0.12).otherwise(-0.15)
    return feedback.select(F.explode(citations).alias("source_file"), delta.alias("d")).groupBy("source_file").agg(F.round(F.sum("d"), 3).alias("boost"))


def boosted(chunks: DataFrame, boosts: DataFrame, score: str = "score") -> DataFrame:
    """Scores moved by their source's boost, inside 0..1."""
    out = chunks.join(F.broadcast(boosts) if boosts.limit(100_001).count() <= 100_000 else boosts, "source_file", "left")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) + F.col("boost")))
    return out.withColumn(score, F.when(F.coalesce("boost", F.lit(0.0)) != 0, moved).otherwise(F.col(score))).drop("boost")


def exemplars(queries: DataFrame, feedback: DataFrame, *, query: str, question: str, rating: str, top: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """(query, feedback_id, overlap, rank): rated questions that hold one or more of the query's words."""
    from lodestone.operators.lexical import bounded, containing

    words = tx.without(tx.words(F.col(question), 3), stop) if stop else tx.words(F.col(question), 3)
    q = queries.select(query, F.explode(words).alias("w"))
    rated = feedback.where(F.col("rating") == rating).select("feedback_id", F.lower(F.trim("query")).alias("low"))
    found = containing(rated, q.select("w").distinct(), key="feedback_id", low="low", term="w")
    hits = found.join(bounded(q), "w").groupBy(query, "feedback_id").agg(F.count(F.lit(1)).alias("overlap"))
    w = Window.partitionBy(query).orderBy(F.desc("overlap"), "feedback_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# --- Sessions -----------------------------------------------------------------------------------------------------


def active(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") >= now)


def validate(sessions: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """claims (session_id, token) with valid: the hash of the token is the session's and it hasn't expired."""
    s = active(sessions, now).select("session_id", "token_sha256")
    j = claims.join(s, "session_id", "left")
    return j.select("session_id", "token", F.coalesce(F.sha2("token", 256) == F.col("token_sha256"), F.lit(False)).alias("valid"))


def signature(files: Column) -> Column:
    return F.array_join(F.array_sort(files), "::")


def list_sessions(sessions: DataFrame, most: int = 8) -> DataFrame:
    """Newest first, without empty ones, one for each set of files, at most `most`."""
    s = sessions.where(F.size("files") > 0).withColumn("signature", signature(F.col("files")))
    s = s.groupBy("signature").agg(F.max_by(F.struct("session_id", "modified_at", "files"), F.struct("modified_at", "session_id")).alias("s")).select("s.*", "signature")
    return s.orderBy(F.desc("modified_at"), F.desc("session_id")).limit(most)


def create_session(sessions: DataFrame, new: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """sessions with new ones (session_id, token and any settings) added, without files, to expire after `hours`; an id that is taken keeps its session."""
    rows = new.join(sessions.select("session_id"), "session_id", "left_anti")
    rows = rows.withColumns({"token_sha256": F.sha2("token", 256), "files": F.array().cast("array<string>"), "modified_at": now, "expires_at": now + hours * 3600}).drop("token")
    return sessions.unionByName(rows, allowMissingColumns=True)


def rehydrate(sessions: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(live sessions of ids with all their settings, sessions without the expired ones among ids)."""
    live = F.col("expires_at") >= now
    asked = ids.select("session_id").distinct()
    return sessions.join(asked, "session_id", "left_semi").where(live), sessions.join(asked.withColumn("_asked", F.lit(True)), "session_id", "left").where(live | F.col("_asked").isNull()).drop("_asked")


def delete_sessions(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids.select("session_id"), "session_id", "left_anti")


def add_files(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """new (session_id, new_files) appended without duplicates, old ones first."""
    j = sessions.join(new, "session_id", "left")
    return j.withColumn("files", F.array_union("files", F.coalesce("new_files", F.array().cast("array<string>")))).drop("new_files")


def clear_except(sessions: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """(kept, one row with the number removed)."""
    return sessions.where(F.col("session_id") == keep), sessions.where(F.col("session_id") != keep).agg(F.count(F.lit(1)).alias("removed"))


def default_session(sessions: DataFrame, now: Column) -> DataFrame:
    """The newest session, live ones before expired ones; no row where there is none (then one is created)."""
    live = (F.col("expires_at") >= now).cast("int")
    return sessions.orderBy(F.desc(live), F.desc("modified_at"), F.desc("session_id")).limit(1)


def last_progress(events: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Latest record of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(at, *values), F.struct(at, *values)).alias("e")).select(key, "e.*")
