"""Token counts: pieces once per distinct pre-token, joined to each document's pre-tokens and summed."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, text_bytes, text_key

#: Fixed value: how the library's byte-level pre-tokenizer cuts a text if its file names no pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most frequent pre-tokens of the corpus, of HOT_BYTES or less each: their counts go out with the tasks.
HOT, HOT_BYTES = 1 << 18, 64
#: Distinct pre-tokens that a task adds up before it passes them on.
REMEMBER = 200_000
#: What a worker process has built, by the definition's checksum; tasks that reuse the process reuse it.
_BUILT: dict[tuple[str, int], object] = {}


def built(kind: type, definition: str):
    """One ``kind(definition)`` per worker process."""
    key = (kind.__name__, crc32(definition.encode()))
    if key not in _BUILT:
        for old in [k for k in _BUILT if k[0] == key[0]]:
            del _BUILT[old]
        _BUILT[key] = kind(definition)
    return _BUILT[key]


def cutting_rules(definition: str) -> str:
    """The definition without its vocabulary: all that cutting a text needs.

    Only byte-level BPE that leaves the text as it is can be counted piece by piece; others are refused.
    """
    spec = json.loads(definition)
    cut = spec.get("pre_tokenizer") or {}
    steps = cut.get("pretokenizers", []) if cut.get("type") == "Sequence" else [cut]
    last = steps[-1] if steps else {}
    split = steps[:-1]
    named = [s for s in split if s.get("type") == "Split" and "Regex" in s.get("pattern", {}) and s.get("behavior") == "Isolated" and not s.get("invert")]
    flags = [t["content"] for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if (
        spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or last.get("type") != "ByteLevel" or last.get("add_prefix_space") or flags
        or not (named == split and len(split) == (0 if last.get("use_regex", True) else 1))
    ):
        raise ValueError("only byte-level BPE without normalizer, prefix space and flagged added tokens is counted by pre-tokens")
    spec["model"] = {"type": "BPE", "vocab": {}, "merges": []}
    spec["post_processor"] = spec["truncation"] = spec["padding"] = None
    return json.dumps(spec)


class Cutter:
    """Cuts texts into pre-tokens as the library does.

    The file's pattern is run by ``regex``. For each character it meets first, a probe shows whether
    both libraries put it in the same class; texts with one that they do not (new scripts, odd white
    space) are cut by the library itself.
    """

    def __init__(self, rules: str) -> None:
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(rules)
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        pattern = regex.compile(steps[0]["pattern"]["Regex"] if steps else PRE_TOKEN)
        self.find, self.spans = pattern.findall, lambda s: [m.span() for m in pattern.finditer(s)]
        self.library = Tokenizer.from_str(rules).pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.agreed: set[str] = set()
        self.odd: set[str] = set()

    def agree(self, c: str) -> bool:
        """Whether a character counts alike beside letters, digits, marks and white space."""
        probe = f"a{c}1{c} !{c} {c}{c} a{c}\n {c}b"
        return [span for _, span in self.library(probe)] == self.spans(probe)

    def _cut(self, text: str) -> list[str]:
        new = set(text) - self.agreed
        if new:
            for c in new - self.odd:
                (self.agreed if self.agree(c) else self.odd).add(c)
            if new & self.odd:
                return [text[a:b] for _, (a, b) in self.library(text)]
        return self.find(text)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens in order, and how many added tokens' strings stand between them."""
        if self.special is None or self.special.search(text) is None:
            return self._cut(text), 0
        between = self.special.split(text)
        return [p for part in between if part for p in self._cut(part)], len(between) - 1


class PieceCounter:
    """How many tokens the library gives for each of some pre-tokens."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_str(definition).encode_batch_fast

    def counts(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for start in range(0, len(pieces), 2048):
            out += map(len, self.encode(pieces[start : start + 2048], add_special_tokens=False))
        return out


def count_pieces(docs: DataFrame, definition: str, *, text_col: str = "text") -> DataFrame:
    """``piece, n, tokens``: each distinct pre-token of all texts, its occurrences, and its tokens, counted once."""
    spark = docs.sparkSession
    rules, whole = spark.sparkContext.broadcast(cutting_rules(definition)), spark.sparkContext.broadcast(definition)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = built(Cutter, rules.value), Counter()
        for batch in rows_of(batches):
            for raw in batch.column(0).to_pylist():
                seen.update(cutter.pieces(raw.decode("utf-8", "replace"))[0])
                if len(seen) > REMEMBER:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = built(PieceCounter, whole.value)
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counter.counts(batch.column(0).to_pylist()), pa.int64())], ["piece", "n", "tokens"])

    seen = docs.select(text_bytes(text_col).alias("text")).mapInArrow(add_up, "piece string, n long")
    return seen.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(encode, "piece string, n long, tokens long")


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of ``counted(n, ...)`` with the highest counts, whole steps of a sixteenth power of 2, ``most`` rows at most.

    Only the number of rows per step goes to the driver; nothing is ordered in one task.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    least, total = None, 0
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return counted.filter(step >= least) if least is not None else counted.limit(0)


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``<id>, n_bytes, n_tokens`` for every row of ``docs``, as the library for ``vocabulary`` gives them.

    ``vocabulary`` is a byte-level BPE file (``.json``) on the driver; its text goes out with the tasks.

    1. All texts are cut into pre-tokens; each distinct one of the corpus is given to the tokenizer
       once. A pre-token alone becomes the same tokens as within its text, so sums are exact.
    2. Each document's pre-tokens are counted. The ``hot`` most frequent pre-tokens of the corpus
       (at most HOT_BYTES each, so some 20 MB) are looked up at once; the others, few a document, are joined to
       the table of step 1 by (text, pre-token) rows, texts that are equal once. No key of that join
       is frequent, as the frequent ones have gone out with the tasks.

    Token ids are made for single pre-tokens only. Added tokens' strings within a text count one
    token each. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are each counted; an
    empty table gives an empty table. Texts of any length are cut whole; other columns are not read, so
    their names do not clash.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rules = spark.sparkContext.broadcast(cutting_rules(definition))
    counted = materialize(count_pieces(docs, definition, text_col=text_col), "pieces")
    top = most_frequent(counted.filter(F.octet_length("piece") <= HOT_BYTES), hot).select("piece", "tokens").toArrow()
    known = spark.sparkContext.broadcast((top.column("piece").to_pylist(), top.column("tokens").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, tokens = built(Cutter, rules.value), dict(zip(*known.value, strict=True))
        find = tokens.get
        for batch in rows_of(batches):
            sums, pieces, times = [], [], []
            for raw in batch.column(4).to_pylist():
                cut, total = cutter.pieces(raw.decode("utf-8", "replace"))
                bag = Counter(cut)
                each = list(map(find, bag))
                if None in each:
                    rest = [(p, n) for (p, n), t in zip(bag.items(), each, strict=True) if t is None]
                    total += sum(t * n for t, n in zip(each, bag.values(), strict=True) if t is not None)
                else:
                    rest = []
                    total += sum(map(int.__mul__, each, bag.values()))
                sums.append(total)
                pieces.append([p for p, _ in rest])
                times.append([n for _, n in rest])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sums, pa.int64()), pa.array(pieces, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                [id_col, "k1", "k2", "n_bytes", "tokens", "pieces", "times"],
            )

    texts = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    texts = texts.select(id_col, *text_key(F.col("text")), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    cut = materialize(texts.mapInArrow(run, f"`{id_col}` {kind}, k1 long, k2 long, n_bytes long, tokens long, pieces array<string>, times array<int>"), "cut")
    open_ = cut.filter(F.size("pieces") > 0)
    pairs = open_.dropDuplicates(["k1", "k2"]).select("k1", "k2", F.inline(F.arrays_zip("pieces", "times"))).withColumnRenamed("pieces", "piece")
    joined = pairs.join(counted.select("piece", F.col("tokens").alias("each")), "piece")
    sums = materialize(joined.groupBy("k1", "k2").agg(F.sum(F.col("times") * F.col("each")).alias("more")), "rest")
    done = cut.filter(F.size("pieces") == 0).select(id_col, "n_bytes", F.col("tokens").alias("n_tokens"))
    return done.unionByName(open_.join(sums, ["k1", "k2"]).select(id_col, "n_bytes", (F.col("tokens") + F.col("more")).alias("n_tokens")))
