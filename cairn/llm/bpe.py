"""Byte-level BPE over a table of distinct words.

Merges never reach over the words that the vocabulary's pattern cuts, so Spark cuts all texts, encodes each distinct word
once, and joins the ids back in the words' places. The most frequent words, up to a fixed size, are broadcast by their
hash; what rarer words give is joined on the word and comes back with the text that holds them.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import frugal, give_back, written

#: Texts are cut into words in stretches of about so many characters.
STRETCH = 1_000_000
#: Words (ids) that are worked on at once.
WORDS = 500_000


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def added_tokens(path: str) -> tuple[str, ...]:
    """The tokens that are cut out of texts before everything else; an error for files of another kind."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    pre = file["pre_tokenizer"] or {}
    if file["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or file["model"]["type"] != "BPE" or (file["decoder"] or {}).get("type") != "ByteLevel":
        raise ValueError(f"{path} is no byte-level BPE file without prefix space")
    added = file["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
        raise ValueError(f"{path} has added tokens that take white space or word edges into account")
    return tuple(sorted((t["content"] for t in added), key=len, reverse=True))


def _newer(spark: SparkSession, path: str) -> tuple[str, str]:
    """Letters and numbers of the tokenizer that the JVM's (older) tables do not have, as parts of a character class."""
    cut = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    known: tuple[list[str], list[str]] = ([], [])
    for lo in range(0, 0x40000, 1 << 15):  # no letters are assigned beyond
        chars = [chr(c) for c in range(lo, lo + (1 << 15)) if not 0xD800 <= c < 0xE000]
        for before, out in zip("a1", known, strict=True):
            spans = {s for _, (s, e) in cut("".join(f"{before}{c}!" for c in chars)) if e - s == 2 and s % 3 == 0}
            out += [c for n, c in enumerate(chars) if 3 * n in spans]
    found = spark.range(1).select(*(F.regexp_replace(F.lit("".join(k)), p, "").alias(p[-2]) for k, p in zip(known, (r"\p{L}", r"\p{N}"), strict=True))).first()
    parts = []
    for chars in found:
        codes = sorted(map(ord, chars))
        if not codes:
            parts.append("")
            continue
        runs = [list(g) for _, g in itertools.groupby(enumerate(codes), lambda x: x[1] - x[0])]
        ranges = "".join(rf"\x{{{r[0][1]:x}}}-\x{{{r[-1][1]:x}}}" for r in runs)
        parts.append(rf"[\x{{{codes[0]:x}}}-\x{{10FFFF}}&&[{ranges}]]")  # a common character meets one test, not all
    return parts[0], parts[1]


_patterns: dict[str, str] = {}


def word_pattern(spark: SparkSession, path: str) -> str:
    """The pattern of byte-level BPE, for the JVM's regular expressions."""
    if path not in _patterns:
        letters, numbers = _newer(spark, path)
        letter, number = rf"\p{{L}}{letters}", rf"\p{{N}}{numbers}"
        _patterns[path] = rf"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]++| ?[{number}]++| ?[^\s{letter}{number}]++|\s+(?!\S)|\s+"
    return _patterns[path]


def _words(text: Column, pattern: str, added: tuple[str, ...]) -> Column:
    """The words of a text in order; an added token is one."""
    cut = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    if not added:
        return cut(text)
    any_of = "|".join(rf"\Q{t}\E" for t in added)
    between, tokens = F.split(text, any_of, -1), F.regexp_extract_all(text, F.lit(any_of), F.lit(0))
    mixed = F.flatten(F.transform(between, lambda t, k: F.concat(cut(t), F.when(k < F.size(tokens), F.array(F.get(tokens, k))).otherwise(F.array().cast("array<string>")))))
    has = functools.reduce(lambda a, b: a | b, (text.contains(t) for t in added))
    return F.when(has, mixed).otherwise(cut(text))


def _stretches(text: Column, size: int) -> Column:
    """The text in parts (structs with `part`, `first`, `last`) that start at a lone space between visible characters,
    where a word always starts."""
    length = F.length(text)
    starts = F.transform(F.sequence(F.lit(1), F.floor((length - 1) / size).cast("int")), lambda k: F.nullif(F.length(F.regexp_extract(F.substring(text, k * size + 1, F.lit(size)), r"(?Us)^.*?\S(?= \S)", 0)), F.lit(0)) + k * size)
    inner = F.filter(starts, lambda s: s.isNotNull())
    part = lambda a, b: F.struct(F.substring(text, a + 1, b - a).alias("part"), (a == 0).alias("first"), (b == length).alias("last"))
    parts = F.zip_with(F.concat(F.array(F.lit(0)), inner), F.concat(inner, F.array(length)), part)
    return F.when(length <= size, F.array(F.struct(text.alias("part"), F.lit(True).alias("first"), F.lit(True).alias("last")))).otherwise(parts)


def word_table(words: DataFrame, path: str) -> DataFrame:
    """Every distinct `word` with its number of occurrences `n`, hash `h` and `ids`, each encoded once; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in batches:
            ids = [x.ids for x in tokenizer.encode_batch_fast(b.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "h", "ids"])

    counted = words.groupBy("word").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("word"))
    return written(counted.mapInArrow(frugal(run), "word string, n long, h long, ids array<int>"), "bpe-words")


class Common:
    """Ids of words by hash: sorted hashes, each of one word of the corpus only."""

    def __init__(self, found: pa.Table) -> None:
        h = found.column("h").combine_chunks().to_numpy()
        lists = found.column("ids").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        start, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        order = np.argsort(h, kind="stable")
        shared = h[order][1:] == h[order][:-1]
        order = order[~(np.append(shared, False) | np.insert(shared, 0, False))] if len(h) else order
        self.h, self.start, self.size = h[order], start[:-1][order].astype(np.int32), np.diff(start)[order].astype(np.int32)
        self.flat = flat.astype(np.uint16 if flat.max(initial=0) < 1 << 16 else np.int32)

    def find(self, hashes: pa.Array) -> np.ndarray:
        """Place of each hash in the table; -1: not there."""
        coded = pc.dictionary_encode(hashes)
        some = coded.dictionary.to_numpy()
        at = np.minimum(np.searchsorted(self.h, some), max(len(self.h) - 1, 0))
        at = np.where(self.h[at] == some, at, -1) if len(self.h) else np.full(len(some), -1)
        return at[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.int64)

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words at these places, and how many each has (-1: none)."""
        size = np.where(at < 0, 0, self.size[at]) if len(self.h) else np.zeros(len(at), np.int64)
        start = self.start[at] if len(self.h) else size
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(start - (ends - size), size) + np.arange(total)].astype(np.int32), size


def choose_common(table: DataFrame, most_words: int, most_bytes: int) -> tuple[DataFrame, bool]:
    """The most frequent words within both bounds, and whether these are all.

    Words of about equal frequency are taken together, so that a histogram is all the driver sees."""
    level = F.floor(F.log2("n") * 8).alias("level")
    steps = sorted(table.groupBy(level).agg(F.count("*"), F.sum(F.size("ids") * 2 + 16)).collect(), reverse=True)
    words = size = 0
    least = None
    for at, n, more in steps:
        words, size = words + n, size + more
        if words > most_words or size > most_bytes:
            break
        least = at
    if steps and least == steps[-1][0] or not steps:
        return table, True
    shared = table.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    some = table.where(level >= least) if least is not None else table.where("false")
    return some.join(shared, "h", "left_anti"), False


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = 4_000_000, most_bytes: int = 96_000_000, stretch: int = STRETCH) -> DataFrame:
    """The token ids of every text, as the vocabulary file's tokenizer gives them without special tokens added: id, ids.

    Strings of added tokens in a text are their ids. Null and empty texts have no ids; repeated rows stay; an empty table
    gives none; other columns are not read. Texts are cut a `stretch` at a time, however long; a text's ids are held in
    memory together. Ids of up to most_words words and most_bytes are broadcast; where there are more words, texts are
    dealt once by their hash to meet the ids of their rarer ones."""
    spark = docs.sparkSession
    pattern, added = word_pattern(spark, path), added_tokens(path)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    parts = lambda frame, *more: frame.select(*more, F.inline(_stretches(F.col("t"), stretch)))
    cut = _words(F.col("part"), pattern, added)
    table = word_table(parts(rows).select(F.explode(cut).alias("word")), path)
    some, whole = choose_common(table, most_words, most_bytes)
    common = spark.sparkContext.broadcast(Common(some.select("h", "ids").toArrow()))
    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    out = f"id {kind}, ids array<int>"
    if whole:
        lined = parts(rows, "id").select("id", "last", cut.alias("words")).select("id", "last", hashes)
        return lined.mapInArrow(frugal(_assembled(common)), out).withColumnRenamed("id", id_col)
    keyed = rows.withColumn("key", F.xxhash64("t"))
    rare = parts(keyed, "key").select("key", cut.alias("words")).select("key", "words", hashes).mapInArrow(frugal(_missed(common)), "key long, word string").distinct()
    tails = rare.join(table.select("word", "ids"), "word").groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("tail"))
    met = keyed.join(tails, "key", "left")
    lined = parts(met, "id", "tail").select("id", "last", F.when(F.col("first"), F.col("tail")).alias("tail"), cut.alias("words")).select("id", "last", hashes, "words", "tail")
    return lined.mapInArrow(frugal(_assembled(common)), out).withColumnRenamed("id", id_col)


def _pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose lists in `column` hold about `most` values; one row at least."""
    for b in batches:
        offsets = b.column(column).offsets.to_numpy().astype(np.int64)
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield b.slice(start, end - start)
            start = end
            give_back()


def _missed(common: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, "hashes"):
            away = np.flatnonzero(common.value.find(b.column("hashes").flatten()) < 0)
            of = np.repeat(np.asarray(b.column("key")), np.asarray(b.column("hashes").value_lengths()))
            yield pa.RecordBatch.from_arrays([pa.array(of[away]), b.column("words").flatten().take(pa.array(away))], names=["key", "word"])

    return run


def _assembled(common: Broadcast):
    """Ids of whole texts from the words of their parts, which follow each other; the first part brings the rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        tail: dict[str, np.ndarray] = {}
        for b in _pieces(batches, "hashes"):
            words = np.asarray(b.column("hashes").value_lengths())
            at = common.value.find(b.column("hashes").flatten())
            flat, size = common.value.ids(at)
            last = np.asarray(b.column("last"))
            if "tail" in b.schema.names:
                ends = np.concatenate([[0], np.cumsum(words)])
                texts, away, lists = b.column("words").flatten(), np.flatnonzero(at < 0), []
                where = np.searchsorted(away, ends)
                for r, own in enumerate(b.column("tail")):
                    if own.is_valid:
                        tail = {x["word"]: np.array(x["ids"], np.int32) for x in own.as_py()}
                    lists += [tail[w] for w in texts.take(pa.array(away[where[r] : where[r + 1]])).to_pylist()]
                    if last[r]:
                        tail = {}
                if lists:
                    more = np.array([len(x) for x in lists])
                    places = np.repeat(np.cumsum(size)[away], more)
                    flat = np.insert(flat, places, np.concatenate(lists))
                    size = size.copy()
                    size[away] = more
            bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(words)])]
            whole = np.flatnonzero(last)
            if not len(whole):
                held.append(flat)
                continue
            head = sum(map(len, held))
            offsets = np.concatenate([[0], bounds[whole + 1] + head])
            values = np.concatenate([*held, flat[: bounds[whole[-1] + 1]]])
            held = [flat[bounds[whole[-1] + 1] :]]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(whole)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], names=["id", "ids"])

    return run


@functools.cache
def _spelling(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of the pieces by id. Byte-level vocabularies write each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, n in vocab.items():
        pieces[n] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    size = np.array([len(p) for p in pieces])
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size


def spelled(path: str, lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts of lists of ids, by a join of ids to pieces, with the flat ids and offsets; broken UTF-8 is replaced."""
    data, start, size = _spelling(path)
    ids, each = lists.flatten().to_numpy(), np.asarray(pc.fill_null(lists.value_lengths(), 0))
    ends = np.cumsum(size[ids])
    total = int(ends[-1]) if len(ends) else 0
    flat = data[np.repeat(start[ids] - (ends - size[ids]), size[ids]) + np.arange(total)]
    bounds = np.concatenate([[0], np.cumsum(each)])
    offsets = np.concatenate([[0], ends])[bounds]
    texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat))
    try:
        texts.validate(full=True)
        flat.tobytes().decode()
    except (pa.ArrowInvalid, UnicodeDecodeError):
        texts = pa.array([flat[a:b].tobytes().decode("utf-8", "replace") for a, b in itertools.pairwise(offsets)], pa.large_string())
    return texts, ids, bounds


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with `text`, what its ids spell, special tokens included; null ids give null, no ids the empty text.

    Repeated rows stay, an empty table gives none; other columns stay, but a column `text` is replaced."""
    fields = [f for f in encoded.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, ids_col):
            texts = spelled(path, b.column(ids_col))[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pc.if_else(b.column(ids_col).is_valid(), texts, None)], names=[*b.schema.names, "text"])

    return encoded.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(frugal(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string"]))


def digests(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id, n_tokens, SHA-256 of the ids as little-endian 32-bit integers, and of the decoded text; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, "ids"):
            texts, ids, bounds = spelled(path, b.column("ids"))
            words = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(np.diff(bounds)), pa.array([hashlib.sha256(words[s:e]).hexdigest() for s, e in itertools.pairwise(bounds)], pa.string()),
                pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string()),
            ], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(frugal(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
