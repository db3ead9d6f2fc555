"""Model calls on text columns: a loader per worker, Arrow batches, and gates that keep rows a model need not see away.

A model is any callable from a list of texts to a list of results; `load` makes it, once a Python worker. No
weights ship with this package: a missing artifact raises, it never scores untrained.
"""

from __future__ import annotations

import itertools
import os
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import blank, normalised, strongest, tokens
from ..functions.values import ASPECTS, NO_MESSAGE
from ..sources.tables import exists
from .sentiment import draw

Model = Callable[[list[str]], list]
MAX_CHARS, MAX_BATCH = 2000, 64


class ModelUnavailable(RuntimeError):
    """The model's artifact is missing or cannot be read."""


class InvalidRequest(ValueError):
    """A request breaks a rule of its schema."""


def require_artifact(path: str) -> str:
    if not os.path.exists(path):
        raise ModelUnavailable(f"no artifact at {path}")
    return path


def loaded(path: str, load: Callable[[str], Model]) -> Model:
    """What `load` makes of the artifact at `path`; one that is missing or cannot be read is ModelUnavailable with its
    reason, never an untrained model."""
    try:
        return load(require_artifact(path))
    except ModelUnavailable:
        raise
    except Exception as error:
        raise ModelUnavailable(f"{path}: {error}") from error


def check_request(texts: list[str], model: str = "bert", language: str = "en") -> None:
    if not 1 <= len(texts) <= MAX_BATCH:
        raise InvalidRequest(f"a batch has 1 to {MAX_BATCH} texts")
    for t in texts:
        if not t or not t.strip() or len(t) > MAX_CHARS:
            raise InvalidRequest(f"a text is not blank and has at most {MAX_CHARS} characters")
    if model not in ("bert", "cnn2d") or language not in ("en", "pt"):
        raise InvalidRequest("unknown model or language")


def scorer(load: Callable[[], Model], batch: int = 32) -> Callable[[Column], Column]:
    """A column of struct(value, failed): the positive probability, or null where the batch failed."""

    @F.pandas_udf("value double, failed boolean")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            values: list[float | None] = []
            for s in range(0, len(part), batch):
                texts = ["" if t is None else t for t in part.iloc[s : s + batch]]
                try:
                    values += [float(x) for x in model(texts)]
                except Exception:  # noqa: BLE001 - a failed batch is reported row by row
                    values += [None] * len(texts)
            yield pd.DataFrame({"value": pd.Series(values, dtype="float64"), "failed": [v is None for v in values]})

    return score


def sentiment(df: DataFrame, load: Callable[[], Model], text: str = "text") -> DataFrame:
    """df with label (Positive, Negative), confidence, probability (4 digits) and failed; the threshold is 0.5."""
    p = F.col("_s.value")
    return df.withColumn("_s", scorer(load)(F.col(text))).withColumns(
        {"label": F.when(p >= 0.5, "Positive").when(p < 0.5, "Negative"), "confidence": F.bround(F.greatest(p, 1 - p), 4), "probability": F.bround(p, 4), "failed": F.col("_s.failed")}
    ).drop("_s")


def fake_check(df: DataFrame, load: Callable[[], Model], text: str = "text", fake_label: str = "LABEL_0") -> DataFrame:
    """df with fake: struct(label, confidence, is_fake); failures are UNKNOWN with 0."""

    @F.pandas_udf("label string, confidence double")
    def check(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            out = []
            for s in range(0, len(part), 32):
                texts = ["" if t is None else t for t in part.iloc[s : s + 32]]
                try:
                    out += [top_label(r) for r in model(texts)]
                except Exception:  # noqa: BLE001 - as scorer()
                    out += [("UNKNOWN", 0.0)] * len(texts)
            yield pd.DataFrame(out, columns=["label", "confidence"])

    return df.withColumn("_f", check(F.col(text))).withColumn("fake", F.struct("_f.label", F.bround("_f.confidence", 4).alias("confidence"), (F.col("_f.label") == fake_label).alias("is_fake"))).drop("_f")


def top_label(result: dict | list) -> tuple[str, float]:
    """Label and score of one result, which is one label or a list of all."""
    best = max(result, key=lambda r: r["score"]) if isinstance(result, list) else result
    return best["label"], float(best["score"])


def fake_tallies(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n_scored"), F.count_if(F.col("fake.label") == "UNKNOWN").alias("n_failed"), F.count_if("fake.is_fake").alias("n_flagged_fake"))


def aspect_rows(df: DataFrame, key: str, text: str, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """key, aspect, text: every text with every aspect (an explode of a fixed list, not a join)."""
    return df.select(key, F.explode(F.array(*[F.lit(a) for a in aspects])).alias("aspect"), text)


def aspect_sentiment(df: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[dict]]], key: str, text: str, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """key, aspect, sentiment, confidence; failures are UNKNOWN with 0."""

    @F.pandas_udf("sentiment string, confidence double")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts, about in parts:
            try:
                out = [top_label(r) for r in model(list(zip(texts, about, strict=True)))]
            except Exception:  # noqa: BLE001 - as scorer()
                out = [("UNKNOWN", 0.0)] * len(texts)
            yield pd.DataFrame(out, columns=["sentiment", "confidence"])

    rows = aspect_rows(df.where(~blank(F.col(text))), key, text, aspects)
    return rows.withColumn("_j", judge(F.col(text), F.col("aspect"))).select(key, "aspect", "_j.sentiment", F.bround("_j.confidence", 4).alias("confidence"))


def sampled_aspects(df: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[dict]]], key: str, text: str, sample: int = 200, seed: int = 42, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """aspect_sentiment() of `sample` rows with text (all, if fewer), the first by the seeded draw of the key."""
    chosen = df.where(~blank(F.col(text))).orderBy(draw(F.col(key), seed), key, text).limit(sample)
    return aspect_sentiment(chosen, load, key, text, aspects)


def aspects_of(load: Callable[[], Callable[[list[tuple[str, str]]], list[dict]]], aspects: tuple[str, ...] = ASPECTS, batch: int = 32) -> Callable[[Column], Column]:
    """A column of array(aspect, sentiment, confidence) in order of aspect; null for blank texts; failures are UNKNOWN with 0."""
    names = sorted(aspects)

    @F.pandas_udf("array<struct<aspect:string,sentiment:string,confidence:double>>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list[list[dict] | None] = []
            for s in range(0, len(part), batch):
                texts = part.iloc[s : s + batch].tolist()
                pairs = [(t, a) for t in texts if t and t.strip() for a in names]
                try:
                    found = [top_label(r) for r in model(pairs)] if pairs else []
                except Exception:  # noqa: BLE001 - as scorer()
                    found = [("UNKNOWN", 0.0)] * len(pairs)
                each = iter(zip(pairs, found, strict=True))
                out += [[{"aspect": a, "sentiment": x, "confidence": round(y, 4)} for (_, a), (x, y) in itertools.islice(each, len(names))] if t and t.strip() else None for t in texts]
            yield pd.Series(out)

    return judge


def full_pipeline(df: DataFrame, models: dict[str, Callable[[], Model]], key: str = "review_id", text: str = "text") -> DataFrame:
    """Sentiment for all, the fake check for negative rows only, aspects for all.

    Spark runs a Python function under a condition for every row, so the gate is a filter and a union. A model that
    `models` lacks gives a null result with its reason.
    """
    if "sentiment" not in models:
        raise ModelUnavailable("sentiment")
    judged = sentiment(df, models["sentiment"], text)
    empty = F.lit(None).cast("struct<label:string,confidence:double,is_fake:boolean>")
    negative = F.col("label").eqNullSafe("Negative")
    if "fake" in models:
        gated = fake_check(judged.where(negative), models["fake"], text).unionByName(judged.where(~negative).withColumn("fake", empty))
        out = gated.withColumn("fake_reason", F.lit(None).cast("string"))
    else:
        out = judged.withColumn("fake", empty).withColumn("fake_reason", F.when(negative, "not loaded"))
    if "aspects" not in models:
        return out.withColumn("aspects", F.lit(None).cast("array<struct<aspect:string,sentiment:string,confidence:double>>")).withColumn("aspects_reason", F.lit("not loaded"))
    return out.withColumn("aspects", aspects_of(models["aspects"])(F.col(text))).withColumn("aspects_reason", F.lit(None).cast("string"))


def to_translate(message: Column, done: Column) -> Column:
    """Rows that translation has still to do."""
    return ~message.eqNullSafe(NO_MESSAGE) & blank(done)


def translate_step(reviews: DataFrame, load: Callable[[], Model], message: str = "review_comment_message", done: str = "review_comment_message_en") -> DataFrame:
    """reviews with `done` filled where it was missing; failed batches leave the empty text. Rows done are not seen again."""
    if done not in reviews.columns:
        reviews = reviews.withColumn(done, F.lit(None).cast("string"))
    todo = to_translate(F.col(message), F.col(done))

    @F.pandas_udf("string")
    def translate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list[str] = []
            for s in range(0, len(part), 32):
                texts = [t if t and t.strip() else "." for t in part.iloc[s : s + 32]]
                try:
                    out += [str(x) for x in model(texts)]
                except Exception:  # noqa: BLE001 - counted by translation_manifest()
                    out += [""] * len(texts)
            yield pd.Series(out)

    return reviews.where(todo).withColumn(done, translate(F.col(message))).unionByName(reviews.where(~todo))


def translate_in_steps(reviews: DataFrame, load: Callable[[], Model], path: str, steps: int = 50, key: str = "review_id", message: str = "review_comment_message", done: str = "review_comment_message_en") -> DataFrame:
    """translate_step() in `steps` parts by a hash of the key, each written below `path` before the next begins.

    The reviews are read once: dealt to a table with a folder a part, of which a step reads its own only, so over a
    whole run a row is read twice. A run that ended early goes on at the first part that was not written whole, from
    that table. Failed batches leave the empty text, so a second run over the result, below another path, tries them
    again."""
    spark = reviews.sparkSession
    dealt = f"{path}/dealt"
    if not exists(spark, f"{dealt}/_SUCCESS"):
        reviews.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(steps)).cast("int")).write.mode("overwrite").partitionBy("_part").parquet(dealt)
    work = spark.read.schema(T.StructType([*reviews.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(dealt)
    places = [f"{path}/step-{n:05d}" for n in range(steps)]
    for n, place in enumerate(places):
        if not exists(spark, f"{place}/_SUCCESS"):
            translate_step(work.where(F.col("_part") == n).drop("_part"), load, message, done).write.mode("overwrite").parquet(place)
    return spark.read.parquet(*places)


def translation_manifest(reviews: DataFrame, message: str = "review_comment_message", done: str = "review_comment_message_en") -> DataFrame:
    real = ~F.col(message).eqNullSafe(NO_MESSAGE)
    return reviews.agg(F.count("*").alias("total_rows"), F.count_if(~blank(F.col(done))).alias("translated_rows"), F.count_if(real & blank(F.col(done))).alias("failed_rows"))


def fit_baseline(df: DataFrame, features: int = 1 << 16, text: str = "text", label: str = "label", weight: str | None = None) -> PipelineModel:
    """Token counts and logistic regression: the native classifier where no network weights exist."""
    words = df.withColumn("_words", tokens(normalised(F.col(text))))
    stages = [CountVectorizer(inputCol="_words", outputCol="features", vocabSize=features), LogisticRegression(labelCol=label, maxIter=30, regParam=0.01, **({"weightCol": weight} if weight else {}))]
    return Pipeline(stages=stages).fit(words)


def predict_baseline(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """df with probability of the positive class and guess."""
    scored = model.transform(df.withColumn("_words", tokens(normalised(F.col(text)))))
    return scored.withColumn("probability", vector_to_array("probability")[1]).withColumn("guess", F.col("prediction").cast("int")).drop("_words", "features", "rawPrediction", "prediction")


def explained(df: DataFrame, model: PipelineModel, k: int = 8, text: str = "text") -> DataFrame:
    """df with top_tokens: the k structs (token, value) of largest weight times count in the baseline's decision, blanks
    leaving after that cut. Rows are taken one by one, so keys may repeat or be null; texts without known tokens get none."""
    counter, classifier = model.stages[0], model.stages[1]
    weights = dict(zip(counter.vocabulary, classifier.coefficients.toArray().tolist(), strict=True))  # at most the vocabulary's size

    @F.pandas_udf("array<struct<token:string,value:double>>")
    def valued(texts: pd.Series) -> pd.Series:
        return texts.map(lambda words: [{"token": w, "value": weights[w] * n} for w, n in Counter(words).items() if w in weights])

    return df.withColumn("top_tokens", strongest(valued(tokens(normalised(F.col(text)))), k))


def attributions(df: DataFrame, model: PipelineModel, k: int = 8, key: str = "review_id", text: str = "text") -> DataFrame:
    """key, token, value: explained() with a row a token."""
    return explained(df.select(key, text), model, k, text).select(key, F.explode("top_tokens").alias("t")).select(key, "t.token", "t.value")


def sampled_explanations(df: DataFrame, model: PipelineModel, sample: int = 8, seed: int = 42, k: int = 5, key: str = "review_id", text: str = "text") -> DataFrame:
    """key, text, top_tokens of `sample` rows, the first by the seeded draw of the key."""
    return explained(df.select(key, text).orderBy(draw(F.col(key), seed), key, text).limit(sample), model, k, text)
