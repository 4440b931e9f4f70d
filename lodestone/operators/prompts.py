"""Prompt assembly, routing and response post-processing as expressions over grouped chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.functions import text as tx

# Tags, word lists and texts that answers and prompts are made of.
URL_TAG = r"\[Image URL:\s*(.*?)\]"
CAPTION_TAG = r"(?i)\[IMAGE / FIGURE:\s*(.*?)\]"
FOCUS = ("diagram", "figure", "image", "chart", "table", "graph", "histogram", "architecture", "training", "model", "pipeline", "what is", "how does", "why")
OVERVIEW = ("summary", "summarise", "overview", "give me a summary", "what is this paper about")
DIAGRAM_REQUEST = ("chart", "diagram", "figure", "plot", "graph", "curve", "schematic")
VISION_MODELS = ("vision", "moondream", "llava", "minicpm", "bakllava", "cogvlm", "vl", "ocr")
AUDIO_VIDEO = (".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg", ".wma", ".mp4", ".mov", ".avi", ".mkv", ".webm", ".wmv", ".m4v")
STYLES = {
    "concise": "\n\nRESPONSE FORMAT DIRECTIVE: Deliver a concise, direct answer using bullet points. Avoid filler introductions or long summaries.",
    "detailed": "\n\nRESPONSE FORMAT DIRECTIVE: Deliver a comprehensive, in-depth explanation with complete context and clear headings.",
}


def excerpt_block(no: Column, source: Column, text: Column) -> Column:
    """One numbered excerpt: URL tags leave the text; a figure tag in the head and an embedding hint take their place."""
    url = F.trim(F.regexp_extract(text, URL_TAG, 1))
    caption = F.trim(F.regexp_extract(text, CAPTION_TAG, 1))
    clean = F.trim(F.regexp_replace(text, r"\[Image URL:\s*.*?\]", ""))
    has = (F.length(url) > 0) | (F.length(caption) > 0)
    label = F.when(F.length(caption) > 0, caption).otherwise(F.concat(F.lit("Figure from "), source))
    hint = F.when(F.length(url) > 0, F.concat(F.lit("\n[ATTACHED DIAGRAM AVAILABLE - Embed inline where discussed using: !["), label, F.lit("]("), url, F.lit(")]"))).otherwise("")
    return F.concat(F.lit("--- DOCUMENT EXCERPT "), no.cast("string"), F.lit(" ("), source, F.when(has, " [Attached Figure Available]").otherwise(""), F.lit(") ---\n"), clean, hint)


def context_blocks(chunks: DataFrame, *, query: str, source: str, text: str, rank: str) -> DataFrame:
    """(query, context): excerpts in rank order, a blank line between."""
    b = chunks.select(query, F.col(rank).alias("r"), excerpt_block(F.col(rank), F.col(source), F.col(text)).alias("b"))
    return b.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "b"))), lambda x: x["b"]), "\n\n").alias("context"))


def markdown_rows(rows: DataFrame, table: str, order: str, cells: list[str]) -> DataFrame:
    """(table, markdown): each table's rows in order under a head of the columns' names; line feeds in a cell become spaces, null is an empty cell."""
    clean = [F.regexp_replace(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"\n", " ") for c in cells]
    line = F.concat(F.lit("| "), F.array_join(F.array(*clean), " | "), F.lit(" |"))
    head = f"| {' | '.join(cells)} |\n| {' | '.join('---' for _ in cells)} |\n"
    g = rows.select(table, F.struct(F.col(order).alias("o"), line.alias("line")).alias("r")).groupBy(table).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n").alias("body"))
    return g.select(table, F.concat(F.lit(head), "body").alias("markdown"))


def history_block(turns: Column) -> Column:
    """turns: array of struct(role, content), the last four in order."""
    said = F.transform(turns, lambda t: F.concat(F.when(t["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), F.trim(t["content"])))
    return F.when(F.size(turns) > 0, F.concat(F.lit("RECENT CONVERSATION MEMORY (PRIOR DIALOGUE TURNS):\n"), F.array_join(said, "\n"), F.lit("\n\n"))).otherwise("")


def focus_hint(question: Column) -> Column:
    low = F.lower(F.trim(question))
    return F.when(~tx.any_of(low, OVERVIEW) & tx.any_of(low, FOCUS), F.concat(F.lit("TARGETED FOCUS DIRECTIVE: The user is asking specifically about: '"), question, F.lit("'. Directly explain and address this specific item.\n\n"))).otherwise("")


def user_prompt(context: Column, question: Column, history: Column, exemplars: Column | None = None, negatives: Column | None = None, image: Column | None = None) -> Column:
    none = F.lit("")
    return F.concat(F.lit("KNOWLEDGE BASE CONTEXT:\n"), context, F.lit("\n\n"), image if image is not None else none, history, exemplars if exemplars is not None else none, negatives if negatives is not None else none, focus_hint(question), F.lit("USER QUERY: "), question, F.lit("\n\nFINISHED GROUNDED ANSWER:"))


def style_suffix(style: Column) -> Column:
    out = F.lit("")
    for k, v in STYLES.items():
        out = F.when(style == k, F.lit(v)).otherwise(out)
    return out


#: What a model's sentence says when it is none, and the bounds on its length.
BOILERPLATE = ("ready to provide", "please ask")
LEAST_SENTENCE, MOST_SENTENCE = 5, 150


def expand_query(question: Column, sentence: Column | None = None) -> Column:
    """Search text: summary and visual questions get fixed expansions; others stay as they are, or take a model's sentence.

    sentence: what a model wrote for each question (a hook's output). It is taken for questions of more than four words,
    its first MOST_SENTENCE characters, unless it is boilerplate or shorter than LEAST_SENTENCE.
    """
    clean = F.trim(question)
    low = F.regexp_replace(F.lower(clean), r"[?!.]+$", "")
    return (
        F.when(F.length(clean) == 0, question)
        .when(tx.any_of(low, tx.SUMMARY_WORDS), F.concat(clean, F.lit(" document summary overview abstract introduction key findings conclusions main contributions")))
        .when(tx.any_of(low, tx.VISUAL_WORDS), F.concat(clean, F.lit(" figure diagram plot chart architecture workflow illustration scene details")))
        .otherwise(clean if sentence is None else F.when(_fit_sentence(clean, sentence), F.concat(clean, F.lit(" "), F.substring(F.replace(F.trim(sentence), F.lit("\n"), F.lit(" ")), 1, MOST_SENTENCE))).otherwise(clean))
    )


def _fit_sentence(question: Column, sentence: Column) -> Column:
    said = F.trim(F.coalesce(sentence, F.lit("")))
    many = F.size(F.filter(F.split(question, r"\s+"), lambda w: F.length(w) > 0)) > 4
    return many & (F.length(said) >= LEAST_SENTENCE) & ~tx.any_of(F.lower(said), BOILERPLATE)


def route_model(question: Column, has_table: Column, image_query: Column, default: str = "default-14b", vision: str = "vision-7b", large: str = "instruct-14b") -> Column:
    n = F.size(F.filter(F.split(F.trim(question), r"\s+"), lambda w: F.length(w) > 0))
    return F.when(image_query | tx.any_of(F.lower(question), DIAGRAM_REQUEST), vision).when(has_table | (n > 15), large).otherwise(default)


def is_vision_model(name: Column) -> Column:
    return tx.any_of(F.lower(name), VISION_MODELS)


def strip_provider(name: Column) -> Column:
    return F.regexp_replace(name, r"^(local:|cloud:|ollama:)", "")


def resolve_model(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """wanted (name) with resolved: the installed name that is equal, has ":latest", or first contains it; null if none."""
    from lodestone.operators.lexical import bounded

    j = wanted.join(bounded(installed.select(F.col("name").alias("inst"), "position")), F.contains(F.lower("inst"), F.lower("name")), "left")
    order = F.when(F.col("inst") == F.col("name"), 0).when(F.col("inst") == F.concat("name", F.lit(":latest")), 1).otherwise(2)
    return j.groupBy("name").agg(F.min_by("inst", F.struct(order.alias("o"), "position")).alias("resolved"))


def catalog_status(catalog: DataFrame, installed: DataFrame, vram: float, ram: float) -> DataFrame:
    """Catalogue with is_installed, compatibility and is_recommended; installed models outside it are appended."""
    base = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    inst = installed.select(F.col("name").alias("inst"))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    # equal names have equal bases, so a tag or a base in common is all there is to look for
    held = inst.select(F.explode(F.array(key("tag", F.col("inst")), key("base", base("inst")))).alias("k")).distinct()
    hit = catalog.select("name", F.explode(F.array(key("tag", F.col("tag")), key("base", base("name")))).alias("k")).join(held, "k", "left_semi").select("name").distinct().withColumn("is_installed", F.lit(True))
    fits = sc.compatibility(F.lit(vram), F.lit(ram), F.col("required_vram_gb"))
    known = catalog.join(hit, "name", "left").select("name", "tag", "category", "size_gb", "required_vram_gb", F.coalesce("is_installed", F.lit(False)).alias("is_installed"), fits.alias("compatibility"))
    known = known.withColumn("is_recommended", F.col("compatibility").isin("recommended", "compatible") & (F.col("size_gb") <= 3.5))
    own = inst.withColumn("base", base("inst")).join(catalog.select(base("name").alias("base")).distinct(), "base", "left_anti")
    vision = tx.any_of(F.lower("inst"), ("vision", "moondream", "llava", "ocr", "vl"))
    own = own.select(F.col("inst").alias("name"), F.col("inst").alias("tag"), F.when(vision, "vision").otherwise("text").alias("category"), F.lit(2.0).alias("size_gb"), F.lit(2.5).alias("required_vram_gb"), F.lit(True).alias("is_installed"), sc.compatibility(F.lit(vram), F.lit(ram), F.lit(2.5)).alias("compatibility"), F.lit(True).alias("is_recommended"))
    return known.unionByName(own)


def relevant_images(chunks: DataFrame, *, query: str, question: str, text: str, score: str, order: str, url: str | None = None, image_query: bool = False) -> DataFrame:
    """(query, url, overlap, relevance, rank) of images to attach, after the intent rules.

    Nothing for questions that decline images or ask for a concept; with explicit visual intent a subject word must
    match; first chunk wins for a URL; three images for visual questions, else one.
    """
    q = F.lower(F.col(question))
    explicit, image = tx.any_of(q, tx.EXPLICIT_VISUAL), F.lit(image_query)
    suppressed = tx.any_of(q, tx.NO_DIAGRAM) | (tx.starts_any(q, tx.CONCEPTUAL) & ~explicit & ~image)
    subject = tx.without(tx.words(F.col(question), 3), tx.STOP_IMAGE)
    tags = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(URL_TAG), F.lit(1)), lambda u: F.trim(u)), lambda u: F.length(u) > 0)
    urls = F.concat(F.when(F.length(F.coalesce(F.col(url), F.lit(""))) > 0, F.array(F.trim(F.col(url)))).otherwise(F.array().cast("array<string>")), tags) if url else tags
    c = chunks.where(~suppressed).withColumns({"_subject": subject, "_explicit": explicit, "_caption": F.trim(F.regexp_extract(F.col(text), CAPTION_TAG, 1))})
    c = c.select("*", F.posexplode(urls).alias("_pos", "url"))
    first = Window.partitionBy(query, "url").orderBy(order, "_pos")
    c = c.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    body = F.lower(F.concat_ws(" ", name, "_caption", F.substring(F.col(text), 1, 1500)))
    c = c.withColumn("overlap", tx.overlap(F.col("_subject"), body)).where(~(F.col("_explicit") & (F.size("_subject") > 0) & (F.col("overlap") == 0)))
    c = c.withColumn("relevance", sc.image_relevance(F.col(score), F.col("overlap")))
    c = c.where(F.col("_explicit") | image | tx.any_of(q, tx.SUMMARY_WORDS[:5]) | (F.col("overlap") > 0))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("overlap"), F.desc("relevance"), order, "_pos"))
    return c.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("_explicit") | image, 3).otherwise(1)).select(query, "url", "overlap", "relevance", "rank")


def image_grounding(decided: DataFrame, *, grounded: str, confidence: str, matched: Column, has_chunks: Column, top_score: Column) -> DataFrame:
    """Answers to image questions: a visual match, or a good enough chunk, grounds them and lifts the confidence to a floor."""
    up = ~F.col(grounded)
    strong, fair = up & matched & has_chunks, up & ~matched & has_chunks & (top_score >= 0.40)
    return decided.withColumns({grounded: F.col(grounded) | strong | fair, confidence: F.when(strong, F.greatest(F.col(confidence), F.lit(0.78))).when(fair, F.greatest(F.col(confidence), F.lit(0.65))).otherwise(F.col(confidence))})


def visual_topic(question: Column, match_info: Column, ocr: Column, description: Column) -> Column:
    toks = F.filter(F.split(F.coalesce(ocr, F.lit("")), r"\s+"), lambda w: (F.length(w) > 1) | w.rlike(r"^[\p{L}\p{N}]$"))
    blank = lambda c: F.when(F.length(c) > 0, c)
    return F.trim(F.concat_ws(" ", F.trim(question), blank(match_info), blank(F.array_join(toks, " ")), blank(F.trim(F.substring(description, 1, 300)))))
