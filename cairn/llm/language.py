"""Language identification by fusing evidence: text likelihoods, declared language, address suffix, host priors.

All evidence enters as log-likelihoods over the languages seen in training plus `und` (no known language):
byte-trigram naive Bayes on the whole text, tempered by its effective length; how a declared language and an address
suffix speak for a language; and a prior for the host that is smoothed towards its domain's (where that has
other hosts), and that towards the whole corpus's. Host and domain counts come from grouped aggregation of all documents' text posteriors, each
document's own share taken out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import Batches, frugal, slices, text_bytes, without, written

#: Host priors are broadcast up to so many numbers (16 bytes each); beyond, each host is dealt to so many parts.
BROADCAST_PRIORS, SPREAD = 2_000_000, 32
BITS = 15
BUCKETS = 1 << BITS
UND = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Languages that country suffixes speak for. Fixed values.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "it": "it",
    "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv", "dk": "da",
    "no": "nb", "fi": "fi", "cz": "cs", "gr": "el", "tr": "tr", "hu": "hu", "ro": "ro", "uk": "en", "us": "en", "au": "en",
    "nz": "en", "ie": "en",
}
#: Language codes of two letters, and those of three that pages declare where there is none of two. Fixed values of the
#: published register (ISO 639). Only these are classes; other declared strings carry no evidence.
REGISTERED = frozenset(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu ast ceb ckb fil haw hmn kab nds scn yue".split()
)
#: Suffixes of two parts under which anyone may take a name: a domain has one part more. Fixed values.
TWO_PART = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "com.br", "com.mx", "com.ar", "com.cn", "com.tr", "co.kr", "co.in", "co.za", "com.pl")


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two; bucket 0 where two of the three
    are no letters or one is a digit."""
    b = _FOLD[data].astype(np.uint32)
    gaps = (b == 32).astype(np.uint8)
    at = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    at[at == 0] = 1
    digit = _DIGIT[data]
    at[(gaps[:-2] + gaps[1:-1] + gaps[2:] >= 2) | digit[:-2] | digit[1:-1] | digit[2:]] = 0
    return at


def _inner_trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """_trigrams of texts laid end to end; bucket 0 where one would reach into the next text."""
    at = _trigrams(data)
    ends = offsets[1:-1]
    for back in (1, 2):
        cross = ends - back
        at[cross[(cross >= 0) & (cross < len(at))]] = 0
    return at


class TextModel:
    def __init__(self, languages: list[str], weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights  # weights: one row of bucket log-probabilities a language

    @staticmethod
    def fit(languages: list[str], counts: np.ndarray, single: np.ndarray, smoothing: float = 0.2) -> TextModel:
        """From trigram counts (a row a language) and the counts of folded bytes."""
        counts[:, 0] = 0
        held = (counts.sum(1, keepdims=True) + smoothing * BUCKETS).clip(1e-9)
        weights = np.log((counts + smoothing) / held)
        # und: half the pooled bytes in independent order, half any trigram at all
        p = np.log((single + 0.5) / (single.sum() + 128))
        kinds = np.flatnonzero(np.bincount(_FOLD, minlength=256))
        grid = np.zeros(BUCKETS)
        pooled = single / max(single.sum(), 1)
        common = kinds[np.argsort(-pooled[kinds])][:64]
        a, b, c = (x.ravel().astype(np.uint8) for x in np.meshgrid(common, common, common, indexing="ij"))
        at = _trigrams(np.stack([a, b, c], 1).ravel())[::3]
        np.add.at(grid, at, np.exp(p[a] + p[b] + p[c]))
        grid[0] = 0
        und = np.log(0.5 * grid / max(grid.sum(), 1e-12) + 0.5 / BUCKETS)
        weights = np.vstack([weights, und])
        weights[:, 0] = 0
        return TextModel([*languages, UND], weights.astype(np.float32))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log-likelihoods (documents x languages), the trigrams that count, and whether there are letters."""
        n = len(offsets) - 1
        out, count, letters = np.zeros((n, len(self.languages))), np.zeros(n), np.zeros(n, bool)
        size = offsets[1:] - offsets[:-1]
        real = np.flatnonzero(size > 0)
        if not len(real):
            return out, count, letters
        letters[real] = np.logical_or.reduceat(_FOLD[data] != 32, offsets[:-1][real])
        real = np.flatnonzero(size > 2)
        if not len(real):
            return out, count, letters
        at = _inner_trigrams(data, offsets)
        starts = offsets[:-1][real]
        for k, w in enumerate(self.weights):
            out[real, k] = np.add.reduceat(w[at].astype(np.float64), starts)
        count[real] = np.add.reduceat((at > 0).astype(np.float64), starts)
        return out, count, letters


def suffix_language(url: Column, known: list[str] | None = None) -> Column:
    """The language an address speaks for: a (known) language code as the first part of its path, else its country suffix."""
    codes = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    path = F.lower(F.regexp_extract(url, r"^[a-z]+://[^/]+/([A-Za-z]{2,3})(?:[-_][A-Za-z]{2,4})?(?:/|$)", 1))
    stated = path.isin(known) if known is not None else F.length(path) == 2
    return F.when(stated, path).otherwise(F.try_element_at(codes, F.regexp_extract(url, r"^[a-z]+://[^/:]*\.([a-z]{2})(?:[:/]|$)", 1)))


def _code(tag: Column) -> Column:
    """The language of a tag, without region and script."""
    return F.nullif(F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,8})(?:[-_]|\s*$)", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    return _code(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1))


def shown_text(html: Column) -> Column:
    """A page without its tags, comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def domain_of(host: Column) -> Column:
    """The name under a public suffix, by a short list of those of two parts; a host without a dot is its own."""
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    three = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return F.coalesce(F.nullif(F.when(two.isin(*TWO_PART), three).otherwise(two), F.lit("")), host)


def sample_labelled(docs: DataFrame, text: Column, label: Column, bound: int, seed: int) -> DataFrame:
    """Whole distinct texts (t, l) of every registered label, for each the `bound` of the smallest draws, or all where it has fewer."""
    named = docs.where(label.isin(*sorted(REGISTERED)) & (F.length(text) > 0))
    counts = named.groupBy(label.alias("label")).agg(F.approx_count_distinct(F.xxhash64(text), 0.02)).collect()
    # twice the bound by an estimate of the distinct texts: enough to rank, without a label's every row in one place
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, (2 * bound + 100) / max(r[1], 1)))]) if counts else F.lit(None).cast("map<string,double>")
    draw = F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = named.select(text.alias("t"), label.alias("l"), draw.alias("u")).where(F.col("u") < F.try_element_at(rates, F.col("l"))).distinct()
    return some.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("u", "t"))).where(F.col("r") <= bound).select("t", "l")


def fit_text_model(labelled: DataFrame) -> TextModel:
    """The model of texts (t, l), their trigrams counted and summed by the executors."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                data, offsets = text_bytes(part.column("t"))
                at = _inner_trigrams(data, offsets) if len(data) > 2 else np.zeros(0, np.uint32)
                names, who = np.unique(np.array(part.column("l").to_pylist(), object), return_inverse=True)
                owner = np.repeat(who, np.diff(offsets))
                # a text that is too short for a trigram says nothing of single bytes either
                lasting = np.repeat(np.diff(offsets) > 2, np.diff(offsets))
                pairs = np.concatenate([owner[: len(at)] * (BUCKETS + 256) + at, owner[lasting] * (BUCKETS + 256) + BUCKETS + _FOLD[data[lasting]]])
                keys, n = np.unique(pairs, return_counts=True)
                yield pa.record_batch([pa.array(names[keys // (BUCKETS + 256)], pa.string()), pa.array((keys % (BUCKETS + 256)).astype(np.int32)), pa.array(n)], names=["l", "b", "n"])

    sums = labelled.mapInArrow(frugal(count), "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums.column("l").to_pylist()))
    number = {x: n for n, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS + 256))
    counts[[number[x] for x in sums.column("l").to_pylist()], np.asarray(sums.column("b"), dtype=np.int64)] = np.asarray(sums.column("n"), dtype=np.float64)
    return TextModel.fit(languages, counts[:, :BUCKETS], counts[:, BUCKETS:].sum(0))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", url_col: str | None = None, html_col: str | None = None, bound: int = 300, declared_trust: float = 0.8, suffix_trust: float = 0.6, weight: float = 8.0, effective: float = 80.0, reject_below: float = 0.5, und_odds: float = 1e-3, seed: int = 17
) -> DataFrame:
    """One row for each row of docs: id, text_hash, lang, posterior, text_lang, declared, host_prior, accepted.

    Every declared language of the register (REGISTERED) with a text that is not empty is a class, under its whole code
    without region and script; other declared strings, however many, carry no evidence, like null ones.
    Training takes up to `bound` distinct whole texts of each (the documented bound of the classifier's sample). The
    declared language is the markup's where html_col is given and states one, else that of declared_col. The host is
    host_col, or the address's where that is None.
    A document is rejected (accepted = false) if no known language is likely: `und` wins or the best posterior is under
    `reject_below`; null, empty and letter-less texts are rejected; a text too short for a trigram is judged by the
    other evidence; very long texts are read whole. Ties go to the first code in alphabetical order. Null declared
    languages, hosts and addresses carry no evidence. Repeated rows give repeated rows; an empty table gives none; other
    columns are not read.
    """
    text = F.col(text_col).cast("string")
    stated = [markup_language(F.col(html_col))] if html_col else []
    stated += [_code(F.col(declared_col))] if declared_col else []
    declared = F.coalesce(*stated) if stated else F.lit(None).cast("string")
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    host = F.col(host_col).cast("string") if host_col else F.lower(F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/:]+)", 1), F.lit("")))
    model = fit_text_model(sample_labelled(docs, text, declared, bound, seed))
    names = model.languages
    number = {x: n for n, x in enumerate(names[:-1])}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                sums, count, letters = model.scores(*text_bytes(part.column("t")))
                logs = sums / np.maximum(count, 1)[:, None] * (count / (1 + count / effective))[:, None]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h", "declared", "suffix", "host")), _lists(logs), _lists(_normal(logs)), pa.array(letters)], names=["id", "h", "declared", "suffix", "host", "logs", "p", "letters"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), declared.alias("declared"), suffix_language(url, names[:-1]).alias("suffix"), host.alias("host"), F.coalesce(text, F.lit("")).alias("t"))
    own = written(frame.mapInArrow(frugal(run), "id long, h long, declared string, suffix string, host string, logs array<double>, p array<double>, letters boolean"), "language")
    k = len(names)
    domain = domain_of(F.col("host"))
    sums = [F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(k)]
    by_host = own.where("host is not null and letters").groupBy("host", domain.alias("domain")).agg(*sums)
    # where a domain is a single host its sums are the host's: the host is smoothed straight to the corpus
    by_domain = by_host.groupBy("domain").agg(*[F.when(F.count("*") > 1, F.sum(f"s{i}")).otherwise(0.0).alias(f"d{i}") for i in range(k)])
    whole = np.array([float(x or 0) for x in own.where("letters").agg(*sums).first()])
    base = (whole + 1) / (whole.sum() + k)
    prior = by_host.join(by_domain, "domain").select("host", F.array(*[F.col(f"s{i}") for i in range(k)]).alias("hs"), F.array(*[F.col(f"d{i}") for i in range(k)]).alias("ds"))
    trust = np.log((1 - declared_trust) / max(k - 1, 1)), np.log(declared_trust), np.log((1 - suffix_trust) / max(k - 1, 1)), np.log(suffix_trust)
    doubt = np.array([np.log(und_odds) if n == UND else 0.0 for n in names])

    def speaks(codes: pa.Array, off: float, on: float) -> np.ndarray:
        """Log-likelihood of stated codes under each language; 0 for codes that are not modelled."""
        coded = pc.dictionary_encode(codes)
        each = np.zeros((len(coded.dictionary) + 1, k))  # the last row is for null
        for r, c in enumerate(coded.dictionary.to_pylist()):
            if c in number:
                each[r] = off
                each[r, number[c]] = on
        return each[coded.indices.fill_null(len(each) - 1).to_numpy()]

    def fuse(batches: Batches) -> Batches:
        for b in batches:
            n = b.num_rows
            logs, p = (np.array(b.column(c).flatten()).reshape(n, k) for c in ("logs", "p"))
            letters = np.array(b.column("letters").to_pylist(), bool)
            hs, ds = (np.array([x if x is not None else [0.0] * k for x in b.column(c).to_pylist()], float).reshape(n, k) for c in ("hs", "ds"))
            counted = letters & np.array(b.column("hs").is_valid())
            mine = p * counted[:, None]
            hs, ds = np.maximum(hs - mine, 0), np.maximum(ds - mine, 0)
            d_prior = (ds + weight * base) / (ds.sum(1, keepdims=True) + weight)
            h_prior = (hs + weight * d_prior) / (hs.sum(1, keepdims=True) + weight)
            q = _normal(logs + np.log(h_prior) + speaks(b.column("declared"), *trust[:2]) + speaks(b.column("suffix"), *trust[2:]) + doubt)
            top, text_top = q.argmax(1), p.argmax(1)
            best = q[np.arange(n), top]
            accepted = letters & (top != k - 1) & (best >= reject_below)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("h"), pa.array([names[i] for i in top]), pa.array(best), pa.array([names[i] if has else None for i, has in zip(text_top, letters, strict=True)], pa.string()), b.column("declared"), pa.array(h_prior[np.arange(n), top]), pa.array(accepted)],
                names=[id_col, "text_hash", "lang", "posterior", "text_lang", "declared", "host_prior", "accepted"],
            )

    prior = written(prior, "host-priors")
    if prior.count() * k <= BROADCAST_PRIORS:
        joined = own.join(F.broadcast(prior), "host", "left")
    else:  # a hot host's rows go to several tasks
        dealt = prior.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        joined = own.withColumn("deal", F.pmod(F.xxhash64("id", "h"), F.lit(SPREAD)).cast("int")).join(dealt, ["host", "deal"], "left")
    joined = joined.select("id", "h", "declared", "suffix", "logs", "p", "letters", "hs", "ds")
    return joined.mapInArrow(frugal(fuse), f"`{id_col}` long, text_hash long, lang string, posterior double, text_lang string, declared string, host_prior double, accepted boolean")


def _normal(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.float64()))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs that identify() accepts, with the columns of docs; nulls, empty and very long texts, repeats and
    empty tables as there."""
    rejected = identify(docs, id_col, text_col, **options).where(~F.col("accepted"))
    return without(docs, rejected, {id_col: F.col(id_col).cast("long"), "text_hash": F.xxhash64(F.col(text_col).cast("string"))}, "rejected")


def identify_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options: object) -> DataFrame:
    """identify() for raw pages: the text they show, their markup's language, address and host. Rows as there."""
    shown = pages.select(id_col, url_col, html_col, shown_text(F.col(html_col)).alias("shown text"))
    return identify(shown, id_col, "shown text", declared_col=None, host_col=None, url_col=url_col, html_col=html_col, **options)
