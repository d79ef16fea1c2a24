"""Alignment of two tokenizers: groups and links of their tokens over the same bytes, and how often ids are linked across the corpus.

A merges bytes (a tokenizers file), B pieces (a sentencepiece file). A text's tokens have cumulative ends in bytes; a two-pointer merge of both lists of ends cuts groups where both end and
emits a link for each pair of tokens that share a byte. That is done in Arrow batches, once for each distinct stretch of a worker: both vocabularies end a token before a
space that follows a character other than white space, so a text is the concatenation of such stretches, and so are its tokens, groups and links. Spark counts for each pair of ids the documents that hold it, finds
the highest count of each id on either side, and joins both back to the pairs of each document. Pairs that many documents hold are looked up in a broadcast table of bounded size, all others by a shuffle.

Both encode the text behind one space (B adds its own). Special strings inside texts are plain text. Texts that are null or empty, or whose bytes either side doesn't give back, have no tokens, no groups and no
links. Repeated rows are documents of their own. Empty tables give empty ones. Extra columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.shared import Scratch

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches that a worker remembers, and their characters together; bytes of text that are aligned at once.
MOST_STRETCHES, MOST_CHARS, SLICE = 400_000, 20_000_000, 1 << 20
#: Pairs that may be broadcast, at most (about 24 bytes each).
MOST_HOT = 1 << 20


#: How the byte-level vocabulary tells words apart; and what is plain Latin text here: printable ASCII and the Latin letters up to U+024F.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile(r"[ -~À-ÖØ-öø-ɏ]+")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens, groups and links of stretches, which are remembered by number."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        self.names = [f"{i}{c}" for own, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(own)) for c in marks]
        self.ranks = self._as_ranks(a_path)
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on behind a space: texts can't be cut there")
        self.forget()

    def _as_ranks(self, path: str):
        """The same merges for a faster library, for stretches of plain Latin text, in which all of them agree what a letter is; none where ids don't follow the order of the merges or
        where the words tried out differ."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
        if ids != sorted(ids) or min(ids) != 256 or len({vocab[c] for c in alphabet if c in vocab}) != 256:
            return None
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        tried = [" " + t for t in vocab if t.isascii() and t.isprintable()][::7]
        slow = [e.ids for e in self.a.encode_batch(tried, add_special_tokens=False)]
        return fast if [fast.encode_ordinary(t) for t in tried] == slow else None

    def _ids(self, stretches: list[str]) -> list[list[int]]:
        """A's tokens of each stretch."""
        if self.ranks is None:
            return [e.ids for e in self.a.encode_batch(stretches, add_special_tokens=False)]
        out = [self.ranks.encode_ordinary(s) if _LATIN.fullmatch(s) else None for s in stretches]
        left = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(left, self.a.encode_batch([stretches[i] for i in left], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.groups, self.pairs = 0, [], []
        self.totals = np.empty((0, 5), dtype=np.int64)  # fine, tokens of A, of B, groups, links

    def given_back(self, texts: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether both sides' bytes of each stretch are the stretch."""
        return [b"".join(map(self.a_bytes.__getitem__, x)) == t == b"".join(map(self.b_bytes.__getitem__, y)) for t, x, y in zip(texts, a, b, strict=True)]

    def merged(self, sizes: np.ndarray, a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[str], list[bytes]]:
        """(groups, links, groups as text, pairs) of stretches of so many bytes that both sides give back; a pair is a * 2^20 + b in 64 bits.

        Both lists of ends are merged for all stretches at once, one behind the other: every stretch ends on both sides.
        """
        ids = [np.fromiter(chain.from_iterable(x), dtype=np.int64) for x in (a, b)]
        first = [np.concatenate([[0], np.cumsum(list(map(len, x)))]).astype(np.int64) for x in (a, b)]
        ends = [np.cumsum(n[i]) for n, i in zip((self.a_size, self.b_size), ids, strict=True)]
        both = ends[0][np.isin(ends[0], ends[1], assume_unique=True)]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        n_groups = np.diff(np.searchsorted(both, edges, "right"))
        # the tokens of b that share a byte with each token of a
        lo = np.searchsorted(ends[1], ends[0] - self.a_size[ids[0]], "right")
        n = np.searchsorted(ends[1], ends[0], "left") - lo + 1
        other = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        pairs = np.repeat(ids[0], n) << 20 | ids[1][other]
        at = np.concatenate([[0], np.cumsum(n)])[first[0]]
        # ids in order of their groups, those of a first, each with what stands behind it
        group = [np.searchsorted(both, e, "left") for e in ends]
        last = [np.isin(e, both, assume_unique=True) for e in ends]
        codes = np.concatenate([2 * ids[0] + last[0], 2 * (len(self.a_size) + ids[1]) + last[1]])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        parts = list(map(self.names.__getitem__, codes[order].tolist()))
        cuts = (first[0] + first[1]).tolist()
        raw, marks = pairs.tobytes(), (8 * at).tolist()
        return n_groups, np.diff(at), ["".join(parts[x:y])[:-1] for x, y in zip(cuts, cuts[1:], strict=False)], [raw[x:y] for x, y in zip(marks, marks[1:], strict=False)]

    def learn(self, stretches: list[str]) -> None:
        """Aligns stretches, each of which begins with a space, and numbers them on."""
        a = self._ids(stretches)
        b = self.b.encode([s[1:] for s in stretches], num_threads=1)
        texts = [s.encode() for s in stretches]
        fine = np.array(self.given_back(texts, a, b))
        totals = np.zeros((len(stretches), 5), dtype=np.int64)
        groups, pairs = [""] * len(stretches), [b""] * len(stretches)
        own = np.flatnonzero(fine)
        if len(own):
            a, b = [a[i] for i in own], [b[i] for i in own]
            n_groups, n_links, names, raw = self.merged(np.array([len(texts[i]) for i in own]), a, b)
            totals[own] = np.stack([np.ones(len(own), np.int64), list(map(len, a)), list(map(len, b)), n_groups, n_links], axis=1)
            for i, x, y in zip(own.tolist(), names, raw, strict=True):
                groups[i], pairs[i] = x, y
        self.number.update(zip(stretches, range(len(self.groups), len(self.groups) + len(stretches)), strict=True))
        self.groups += groups
        self.pairs += pairs
        self.chars += sum(map(len, stretches))
        self.totals = np.concatenate([self.totals, totals])

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, offsets): the stretches of text i have the numbers from offsets[i] to offsets[i + 1]; a text that either side doesn't give back has none."""
        if len(self.groups) > MOST_STRETCHES or self.chars > MOST_CHARS:
            self.forget()
        found = [stretches(t) if t else [] for t in texts]
        new = sorted(s for s in set(chain.from_iterable(found)) if s not in self.number)
        for i in range(0, len(new), 1000):
            self.learn(new[i : i + 1000])
        own = [list(map(self.number.__getitem__, f)) for f in found]
        fine = self.totals[:, 0] == 1
        if not fine.all():
            odd = set(np.flatnonzero(~fine).tolist())
            for i, text in enumerate(texts):
                if not odd.isdisjoint(own[i]):
                    # a stretch alone isn't given back: only the whole text counts
                    if " " + text not in self.number:
                        self.learn([" " + text])
                    k = self.number[" " + text]
                    own[i] = [k] if self.totals[k, 0] else []
        offsets = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(own), dtype=np.int64, count=int(offsets[-1])), offsets


#: Behind one of these no stretch begins: white space, or what some libraries take for it.
_OPEN = r"\s\u180e\u200b-\u200d\u2060\ufeff"
_ODD = re.compile(rf"^ |[{_OPEN}] | $")
_STRETCH = re.compile(rf"(?<=[^{_OPEN}])(?= +[^ ])")


def stretches(text: str) -> list[str]:
    """The stretches of a text behind one space; each begins with a space. Spaces that end the text belong to the last one."""
    if _ODD.search(text) is None:
        return list(map(" ".__add__, text.split(" ")))
    return _STRETCH.split(" " + text)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker and pair of files."""
    if (a_path, b_path) not in _aligners:
        _aligners[(a_path, b_path)] = Aligner(a_path, b_path)
    return _aligners[(a_path, b_path)]


_ALIGNED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a:int,b:int,n:int>>"


def _pairs_of(numbers: np.ndarray, offsets: np.ndarray, al: Aligner) -> pa.Array:
    """The distinct pairs of each text and how often each is linked there."""
    n = len(offsets) - 1
    docs = np.repeat(np.arange(n), np.diff(offsets))
    keys, counts = np.unique(docs << 32 | numbers, return_counts=True)
    which = keys & 0xFFFFFFFF
    pairs, sizes = np.frombuffer(b"".join(map(al.pairs.__getitem__, which.tolist())), dtype=np.int64), al.totals[which, 4]
    doc, times = np.repeat(keys >> 32, sizes), np.repeat(counts, sizes)
    order = np.argsort(doc << 40 | pairs, kind="stable")  # a pair has 40 bits
    doc, pairs, times = doc[order], pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pairs[1:] != pairs[:-1])])) if len(doc) else np.empty(0, np.int64)
    sums = np.add.reduceat(times, first) if len(first) else np.empty(0, np.int64)
    doc, pairs = doc[first], pairs[first]
    flat = pa.StructArray.from_arrays([pa.array(pairs >> 20, pa.int32()), pa.array(pairs & 0xFFFFF, pa.int32()), pa.array(sums, pa.int32())], names=["a", "b", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), flat)


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        for whole in batches:
            texts = whole.column("text").to_pylist()
            part, at = np.cumsum([len(t or "") for t in texts]) // SLICE, 0
            for cut in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]:
                if cut <= at:
                    continue
                numbers, offsets = al.aligned(texts[at:cut])
                sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(al.totals[numbers], axis=0)])
                totals = sums[offsets[1:]] - sums[offsets[:-1]]
                names = list(map(al.groups.__getitem__, numbers.tolist()))
                groups = [";".join(names[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                cols = [whole.column("uid").slice(at, cut - at), whole.column("doc_id").slice(at, cut - at), *[pa.array(totals[:, k]) for k in range(1, 5)], pa.array(groups, pa.string()), _pairs_of(numbers, offsets, al)]
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])
                at = cut

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(uid, doc_id, n_a, n_b, n_groups, n_links, groups, pairs) of every row of docs (doc_id, text). groups is 'a1,a2|b1;a3|b2,b3': the ids of each group, in order; pairs are the linked ids and how
    often they are linked. uid tells rows apart within one job: store the result."""
    slim = docs.select(F.col("doc_id").cast("long"), "text").withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text")
    return slim.mapInArrow(_align(a_path, b_path), _ALIGNED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, a_most, b_most) of pairs (a, b; a row for each document that holds them): documents, and the highest count of a pair of this a, and of this b."""
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))
    most = [counts.groupBy(side).agg(F.max("count").alias(f"{side}_most")) for side in "ab"]
    return counts.join(most[0], "a").join(most[1], "b")


def with_counts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (uid, pairs) as (uid, count_sum, n_best, n_best_b): over the links of each document, the sum of the pairs' counts, and how many links' counts are the highest of their a, or of their b.

    pairs: a stored table of pair_counts(). Those of the highest counts, at most MOST_HOT, are broadcast.
    """
    steps = pairs.select(F.floor(F.log2(F.col("count").cast("double"))).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 63
    left, least = MOST_HOT, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        left -= r["n"]
        if left < 0:
            break
        least = 1 << int(r["step"])
    each = rows.select("uid", F.explode("pairs").alias("p")).select("uid", "p.a", "p.b", "p.n")
    hot = F.broadcast(pairs.where(F.col("count") >= least))
    met = each.join(hot, ["a", "b"])
    if left < 0:
        cold = each.join(F.broadcast(pairs.where(F.col("count") >= least).select("a", "b")), ["a", "b"], "left_anti").join(pairs.where(F.col("count") < least), ["a", "b"])
        met = met.unionByName(cold)
    best = [F.sum(F.when(F.col("count") == F.col(f"{side}_most"), F.col("n")).otherwise(0)) for side in "ab"]
    return met.groupBy("uid").agg(F.sum(F.col("n") * F.col("count")).alias("count_sum"), best[0].alias("n_best"), best[1].alias("n_best_b"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "token_align")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = aligned(docs, public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    rows = scratch.put(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    pairs = scratch.put(pair_counts(rows.select(F.explode("pairs").alias("p")).select("p.a", "p.b")), "pairs")
    sums = with_counts(rows.select("uid", "pairs"), pairs)
    met = rows.drop("pairs").join(sums, "uid", "left")
    return met.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum", "n_best_b")], "groups_sha256")
