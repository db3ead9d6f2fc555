"""The read layer: one function a route, each returning rows as objects or one object, over a Market."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import explain, kpis, rfm, scoring, stats
from ..sources.results import Results, records, safe
from ..sources.tables import exists
from .batch import CURRENT, DOCUMENTS, current
from .market import Market

VERSION = "v1"
#: Rows that prepared documents hold at most; a request for more is answered from the tables.
LENGTHS = {"top_cities": 10, "late_sellers": 20, "top_categories": 15, "late_by_state": 15}


class NotFound(LookupError):
    """There is no such item; the message names what there is."""


def envelope(data: object, request_id: str = "", model_version: str = "none") -> dict:
    return {"success": True, "data": safe(data), "meta": {"api_version": VERSION, "model_version": model_version, "request_id": request_id}}


def failure(error: Exception) -> dict:
    """The error envelope and its status: 404, 503, 422 or 500."""
    status = 404 if isinstance(error, NotFound) else 503 if isinstance(error, scoring.ModelUnavailable) else 422 if isinstance(error, (scoring.InvalidRequest, ValueError)) else 500
    return {"success": False, "error": {"status": status, "message": str(error)}}


class Api:
    """Answers from the documents and the segmentation of a batch run (`prepared`: where runs are published, or one
    run's folder) where it is given, and from the market's tables else. Of a run, a document that is missing is NotFound
    for the business, delivery and segment summaries and an empty list for lists; nothing is computed in its place.
    Customers' and sellers' summaries, and lists longer than the documents', come from the tables. `reasons` tells why a model could not be loaded."""

    def __init__(self, market: Market, models: dict | None = None, prepared: str | None = None, reasons: dict[str, str] | None = None) -> None:
        self.market, self.models, self.reasons = market, models or {}, reasons or {}
        self.prepared = current(market.spark, prepared) if prepared and exists(market.spark, f"{prepared}/{CURRENT}") else prepared
        self.results = Results(market.spark, self.prepared, DOCUMENTS) if prepared else None

    def _rows(self, name: str, n: int | None = None) -> list[dict] | None:
        """A prepared document's rows, the first n of them; None where nothing is prepared, or too little to tell."""
        if self.results is None or (n is not None and n > LENGTHS[name]):
            return None
        held = self.results.get(name)
        if held is None and name == "rfm_summary":
            raise NotFound(f"no document {name}")
        return held["rows"][:n] if held else []

    def _object(self, name: str) -> dict | None:
        held = self.results.get(name) if self.results else None
        if self.results and held is None and name in ("business_summary", "delivery_summary"):
            raise NotFound(f"no document {name}")
        return None if held is None else {k: v for k, v in held.items() if k not in ("generated_at", "schema_version")}

    def root(self) -> dict:
        return {"name": "cairn", "api_version": VERSION}

    def health(self) -> dict:
        """ok where data can be read, else degraded with the reason."""
        if self.results is not None:
            missing = sorted(set(DOCUMENTS) - set(self.results.available()))
            return {"status": "degraded", "reason": f"missing documents: {', '.join(missing)}"} if missing else {"status": "ok"}
        try:
            self.market.orders_enriched.schema
        except Exception as error:  # noqa: BLE001 - any failure to read is what is reported
            return {"status": "degraded", "reason": str(error).splitlines()[0]}
        return {"status": "ok"}

    def models_status(self) -> dict:
        return {n: {"available": n in self.models, "reason": None if n in self.models else self.reasons.get(n, "not loaded")} for n in ("sentiment", "fake", "aspects")}

    def models_info(self) -> dict:
        """What each model is for; the classes tell how it was made."""
        purpose = {"sentiment": "positive probability of a text", "fake": "check of negative reviews", "aspects": "sentiment about fixed aspects", "baseline": "token-count classifier for explanations"}
        return {n: {"purpose": p, "available": n in self.models, "kind": type(self.models[n]).__name__ if n in self.models else None} for n, p in purpose.items()}

    def summary(self) -> dict:
        m = self.market
        return self._object("business_summary") or records(kpis.business_summary(m.order_facts, m.delivered))[0]

    def monthly_orders(self) -> list[dict]:
        held = self._rows("monthly_orders")
        return held if held is not None else records(kpis.monthly_orders(self.market.orders_enriched))

    def monthly_revenue(self) -> list[dict]:
        held = self._rows("monthly_revenue")
        return held if held is not None else records(kpis.monthly_revenue(self.market.orders_enriched, self.market.delivered))

    def review_distribution(self) -> list[dict]:
        held = self._rows("review_scores")
        return held if held is not None else records(kpis.review_scores(self.market.orders_enriched))

    def delivery_summary(self) -> dict:
        return self._object("delivery_summary") or records(kpis.delivery_summary(self.market.orders_enriched))[0]

    def payment_distribution(self) -> list[dict]:
        held = self._rows("payment_methods")
        return held if held is not None else records(kpis.counts(self.market.orders_enriched, "main_payment_type"))

    def late_significance(self) -> dict:
        return self._object("late_significance") or safe(stats.late_significance(self.market.orders_enriched))

    def customer_summary(self) -> dict:
        return self._object("customer_summary") or records(kpis.customer_summary(self.market.customers_enriched))[0]

    def top_cities(self, n: int = 10) -> list[dict]:
        held = self._rows("top_cities", n)
        return held if held is not None else records(kpis.top_cities(self.market.orders_enriched, n))

    def seller_summary(self) -> dict:
        return self._object("seller_summary") or records(kpis.seller_summary(self.market.sellers_enriched))[0]

    def seller_performance(self, n: int = 20) -> list[dict]:
        held = self._rows("late_sellers", n)
        return held if held is not None else records(kpis.late_sellers(self.market.sellers_enriched, n))

    def categories(self, n: int = 15) -> list[dict]:
        held = self._rows("top_categories", n)
        return held if held is not None else records(kpis.top_categories(self.market.items_categorised, n))

    def state_performance(self, n: int = 15) -> list[dict]:
        held = self._rows("late_by_state", n)
        return held if held is not None else records(kpis.late_by_state(self.market.orders_enriched, n))

    @cached_property
    def segmentation(self) -> rfm.Segmentation:
        """The batch run's, else fitted once."""
        if self.prepared:
            return rfm.Segmentation.load(self.market.spark, f"{self.prepared}/segmentation")
        return rfm.fit_segments(rfm.rfm_table(self.market.orders_enriched))

    @cached_property
    def _profile(self) -> list[dict]:
        held = self._rows("rfm_summary")
        return held if held is not None else records(rfm.segment_profile(self.segmentation.assign(rfm.rfm_table(self.market.orders_enriched))))

    def segments(self) -> list[dict]:
        return self._profile

    def segment(self, name: str) -> dict:
        found = [r for r in self._profile if r["Segment"].lower() == name.lower()]
        if not found:
            raise NotFound(f"no segment {name}; there are {', '.join(r['Segment'] for r in self._profile)}")
        return found[0]

    def predict_segment(self, recency: float, frequency: float, monetary: float) -> dict:
        return self.segmentation.predict(recency, frequency, monetary)

    def score(self, texts: list[str] | list[dict], model: str = "bert", language: str = "en") -> list[dict]:
        """Sentiment of 1 to 64 texts (or objects with id and text), in their order, with id, model and the text that was
        scored; texts in Portuguese are translated first."""
        items = [t if isinstance(t, dict) else {"id": None, "text": t} for t in texts]
        scoring.check_request([t["text"] for t in items], model, language)
        if "sentiment" not in self.models:
            raise scoring.ModelUnavailable("sentiment")
        rows = self.market.spark.createDataFrame([(n, None if t["id"] is None else str(t["id"]), t["text"]) for n, t in enumerate(items)], "position int, id string, text string")
        if language == "pt":
            if "translation" not in self.models:
                raise scoring.ModelUnavailable("translation")
            rows = scoring.translate_step(rows.withColumnRenamed("text", "original"), self.models["translation"], "original", "text")
        scored = scoring.sentiment(rows, self.models["sentiment"]).withColumn("model", F.lit(model))
        return records(scored.orderBy("position").drop("position"))

    def pipeline(self, texts: list[str]) -> list[dict]:
        scoring.check_request(texts)
        rows = self.market.spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "review_id string, text string")
        return records(scoring.full_pipeline(rows, self.models).orderBy("review_id"))

    def explain(self, text: str, k: int = 8) -> dict:
        """What the tokens of most weight add to the answer of the model that scores texts, to nothing added by none;
        without it, to the baseline's decision."""
        scoring.check_request([text])
        rows = self.market.spark.createDataFrame([("0", text)], "review_id string, text string")
        if "sentiment" in self.models:
            told = records(explain.top_tokens(rows, self.models["sentiment"], k))[0]
            return {"available": not told["failed"], "model": "sentiment", "base": told["base"], "score": told["score"], "top_tokens": told["top_tokens"] or []}
        if "baseline" not in self.models:
            raise scoring.ModelUnavailable("neither sentiment nor baseline is loaded")
        found = scoring.attributions(rows, self.models["baseline"], k).select("token", "value").orderBy(F.desc(F.abs("value")), "token")
        return {"available": True, "model": "baseline", "base": None, "score": None, "top_tokens": records(found)}
