"""Models as plug-ins: loaded once in a worker, called in batches, tried again, and followed by others where they fail.

A model is (name, load): ``load()`` gives a function from a list of inputs to a list of as many outputs, and is called
once in a worker process, when the first batch comes. A model that doesn't load, fails RETRIES times on a batch, or returns
a wrong number of outputs is passed over, the next one takes the batch, and the output names who did. Results of a row
never depend on the rows it shares a batch with, as long as a model's don't.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import dense
from lodestone.sources.store import EMBEDDING_MODELS

Model = tuple[str, Callable[[], Callable[[list], list]]]

BATCH, RETRIES, WAIT = 64, 2, 1.2

_loaded: dict[str, object] = {}


def _model(key: str, load: Callable[[], Callable[[list], list]]):
    """The loaded model of this worker process, or the exception that loading it raised."""
    if key not in _loaded:
        try:
            _loaded[key] = load()
        except Exception as e:  # noqa: BLE001  a model that doesn't load is one that fails
            _loaded[key] = e
    return _loaded[key]


def called(models: list[Model], inputs: list, retries: int = RETRIES, wait: float = WAIT, again: Callable[[Exception], bool] = lambda e: True, scope: str = "") -> tuple[str | None, list]:
    """(name of the model that answered, its outputs); (None, nulls) where none did. again: whether an error is worth another try."""
    for name, load in models:
        model = _model(f"{scope}/{name}", load)
        if isinstance(model, Exception):
            continue
        for attempt in range(max(1, retries)):
            try:
                out = list(model(inputs))
                if len(out) != len(inputs):
                    raise ValueError(f"{name} gave {len(out)} outputs for {len(inputs)} inputs")
                return name, out
            except Exception as e:  # noqa: BLE001  the next try, or the next model
                if attempt + 1 >= retries or not again(e):
                    break
                time.sleep(wait)
    return None, [None] * len(inputs)


def hook(models: list[Model], kind: str, *, batch: int = BATCH, retries: int = RETRIES, wait: float = WAIT, again: Callable[[Exception], bool] = lambda e: True, scope: str = ""):
    """A function of one or more columns to struct<model: string, value: kind>. Several columns reach a model as tuples; null inputs are not sent, and give null.

    scope tells apart models of one name that are different functions.
    """

    @F.pandas_udf(f"struct<model: string, value: {kind}>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            alone = isinstance(columns, pd.Series)  # as Spark passes one column
            rows = columns.tolist() if alone else list(zip(*columns, strict=True))
            missing = lambda x: x is None or (isinstance(x, float) and x != x)  # noqa: E731  numbers come with NaN for null
            send = [k for k, r in enumerate(rows) if not (missing(r) if alone else any(map(missing, r)))]
            names, values = [None] * len(rows), [None] * len(rows)
            for lo in range(0, len(send), batch):
                part = send[lo : lo + batch]
                name, out = called(models, [rows[k] for k in part], retries, wait, again, scope)
                for k, v in zip(part, out, strict=True):
                    names[k], values[k] = name, v
            yield pd.DataFrame({"model": pd.Series(names, dtype=object), "value": pd.Series(values, dtype=object)})

    return run


def prefixed(text: Column, model: str, kind: str = "query") -> Column:
    """The text after the prefix that a model's catalogue entry asks for; models without an entry have none."""
    of = {name: (q, p) for name, _, q, p in EMBEDDING_MODELS}
    prefix = of.get(model, ("", ""))[0 if kind == "query" else 1]
    return F.concat(F.lit(prefix), text) if prefix else text


def embed(texts: DataFrame, text: str, models: list[Model], *, kind: str = "query", dim: int = 384, out: str = "vector", **options) -> DataFrame:
    """texts with `out`, a vector of length 1, and `embedder`, who made it: the first model that answers, each asked with its own prefix, else the hash embedding.

    Null texts count as empty.
    """
    scope = options.pop("scope", "embed")
    d, body = texts, F.coalesce(F.col(text), F.lit(""))
    tried: list[Column] = []
    for k, (name, load) in enumerate(models):
        # a later model only sees the rows that none before it answered
        open_ = body if not tried else F.when(F.coalesce(*(F.col(f"_m{j}.model") for j in range(k))).isNull(), body)
        d = d.withColumn(f"_m{k}", hook([(name, load)], "array<double>", scope=scope, **options)(prefixed(open_, name, kind)))
        tried.append(F.col(f"_m{k}"))
    left = body if not tried else F.when(F.coalesce(*(t["model"] for t in tried)).isNull(), body)
    plain = dense.embedder(dim)
    d = d.withColumn("_hash", F.when(left.isNotNull(), plain(F.coalesce(left, F.lit("")))))
    value = F.coalesce(*(t["value"] for t in tried), "_hash") if tried else F.col("_hash")
    name = F.coalesce(*(t["model"] for t in tried), F.lit("hash")) if tried else F.lit("hash")
    length = F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(length > 0, F.transform(value, lambda x: x / length)).otherwise(value)
    return d.withColumns({out: unit, "embedder": name}).drop("_hash", *(f"_m{k}" for k in range(len(models))))


def logits(candidates: DataFrame, models: list[Model], *, question: str = "question", text: str = "text", out: str = "logit", **options) -> DataFrame:
    """candidates with a cross-encoder's logit of (question, text); null where no model answers, for rerank() to fall back on the distance."""
    return candidates.withColumn(out, hook(models, "double", scope=options.pop("scope", "rerank"), **options)(question, text)["value"])


def server_error(e: Exception) -> bool:
    """Errors worth a second try: those that name status 500."""
    return "500" in str(e)


def generate(prompts: DataFrame, prompt: str, models: list[Model], fallback: Column, *, out: str = "answer", **options) -> DataFrame:
    """prompts with an answer and its `generator`: the first model that answers, tried again after a server error; else the fallback column."""
    given = {"again": server_error, "batch": 1, "scope": "generate"} | options
    r = hook(models, "string", **given)(prompt)
    d = prompts.withColumn("_g", r)
    return d.withColumns({out: F.coalesce(F.trim(F.col("_g.value")), fallback), "generator": F.coalesce("_g.model", F.lit("fallback"))}).drop("_g")


#: What stands for a crop or an image that no model describes.
NO_DESCRIPTION = "Visual diagram crop containing architectural or workflow components."
#: The kinds a crop may be.
CROP_KINDS = ("photo", "diagram", "chart", "graph", "table", "illustration", "other")


def lenient_json(reply: Column, schema: str) -> Column:
    """The object between the first opening and the last closing brace of a reply, as a struct; null where there is none, or it is no JSON."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(body != "", body), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(parsed["_bad"].isNull(), parsed)


def crop_class(reply: Column) -> Column:
    """struct<type, description> of a model's reply about a crop: its JSON where it has some, the whole reply as a diagram's description where it has none, a fixed description where it is null or broken JSON."""
    text = F.trim(reply)
    braces = F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))
    j = lenient_json(text, "type string, description string")
    kind = F.when(braces & j.isNotNull(), F.lower(F.coalesce(j["type"], F.lit("diagram")))).otherwise("diagram")
    said = F.when(reply.isNull() | (braces & j.isNull()), F.lit(NO_DESCRIPTION)).when(braces, F.coalesce(j["description"], text)).otherwise(text)
    return F.struct(kind.alias("type"), said.alias("description"))


def classify_crops(crops: DataFrame, image: str, models: list[Model], **options) -> DataFrame:
    """crops with `type` and `description` by a vision model over their bytes."""
    r = hook(models, "string", scope=options.pop("scope", "vision"), **options)(image)["value"]
    return crops.withColumn("_r", r).withColumn("_c", crop_class(F.col("_r"))).withColumns({"type": F.col("_c.type"), "description": F.col("_c.description")}).drop("_r", "_c")


#: The heads of a summary's parts, and what stands for an image that shows nothing.
TEXT_HEAD, VISION_HEAD, NOTHING = "Text detected in image:\n", "Visual Analysis & Details:\n", "Image provided with no detectable text or description."


def describe_images(images: DataFrame, image: str, ocr: list[Model], vision: list[Model], **options) -> DataFrame:
    """images with `described`: struct<ocr_text, description, combined_summary>.

    The text is that of the first OCR model that answers; the description has a line for every vision model that does, in
    the order of the models. Blank answers count as none; an image that is null has three empty strings.
    """
    scope = options.pop("scope", "describe")
    value = lambda models, part: F.coalesce(F.trim(hook(models, "string", scope=f"{scope}/{part}", **options)(image)["value"]), F.lit(""))
    d, lines = images.withColumn("_o", value(ocr, "ocr") if ocr else F.lit("")), []
    for k, model in enumerate(vision):
        d = d.withColumn(f"_v{k}", value([model], "vision"))
        lines.append(F.when(F.col(f"_v{k}") != "", F.concat(F.lit(f"[{model[0]}]: "), F.col(f"_v{k}"))))
    shown = lambda *parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    text, said = F.col("_o"), F.array_join(shown(*lines), "\n") if lines else F.lit("")
    parts = shown(F.when(text != "", F.concat(F.lit(TEXT_HEAD), text)), F.when(said != "", F.concat(F.lit(VISION_HEAD), said)))
    summary = F.when(F.col(image).isNull(), "").when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(NOTHING)
    return d.withColumn("described", F.struct(text.alias("ocr_text"), said.alias("description"), summary.alias("combined_summary"))).drop("_o", *(f"_v{k}" for k in range(len(vision))))
