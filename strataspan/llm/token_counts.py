"""Token counts by prefix dynamic programming.

The table of a text holds the exact token count of every prefix that ends with a word: the count of the prefix before the word plus the word's own count. Distinct
words of plain Latin letters, digits and signs are counted for each batch by tiktoken with the same merges, where the file allows that; for the others the library is asked once for each that isn't
remembered. Tables are stored; counts, limits, truncation and budgets are read from them without encoding again. Prefixes that end inside a word add a second table, of the word's characters: the encoding of a prefix of a word is
the encoding of a shorter one and one more token, the one whose join with the last token before it the merges leave as it is, so counts follow
by dynamic programming over the word's ends. (Only words with letters beyond ASCII, an apostrophe or a special string are left to the library there,
since their normal forms and pieces may change with the end.)

Counting word by word needs a file whose normalizer and pre-tokenizer keep words apart at spaces, tabs and line ends; that is tried out when a file is
loaded, and a file that doesn't raises ValueError.

Null texts count as empty: no tokens, an empty table. Texts of any length are read whole. An empty table gives an empty one. Extra columns are not read; repeated
rows are counted each.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.shared import Scratch

#: Only these separate words here: a subset of what the vocabulary drops, so that any other white space is left to the library.
SEPARATORS = " \t\n\r"
_SPLIT = re.compile(r"[^ \t\n\r]+")

#: Words longer than this are encoded each time; so many words are remembered at most.
LONG_WORD, CACHE_WORDS = 64, 200_000
#: Texts of about so many bytes are counted at once, and so many plain words: what a worker holds besides its Arrow batch.
GROUP_BYTES, SLICE_WORDS = 3 << 20, 20_000

#: The steps before the merges that PlainWords knows.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_PIECES = {"type": "Sequence", "pretokenizers": [_SPLITTER, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class WordPrefixes:
    """Counts of the prefixes of a word under a BPE of merges, by dynamic programming over the ends."""

    def __init__(self, model: dict):
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab), default=1)
        self.joins: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            bare = token[: -len(self.suffix)]
            return [*bare[:-1], bare[-1] + self.suffix] if bare else [token]
        return list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def _follows(self, before: str | None, token: str) -> bool:
        """Whether the merges leave these two tokens as they are beside each other."""
        key = (before or "", token)
        if key not in self.joins:
            if len(self.joins) > 1_000_000:
                self.joins.clear()
            own = [token] if before is None else [before, token]
            self.joins[key] = self._merged([s for t in own for s in self._symbols(t)]) == own
        return self.joins[key]

    def counts(self, piece: str) -> list[int]:
        """Tokens of piece[:1], piece[:2], ..., each as a piece of its own."""
        n = len(piece)
        last: list[str | None] = [None] * (n + 1)  # the last token of piece[:i] without a word's end
        open_count, out = [0] * (n + 1), []
        for i in range(1, n + 1):
            for ended in (False, True):
                tail = self.suffix if ended else ""
                for j in range(max(0, i - self.longest), i):
                    token = piece[j:i] + tail
                    if token in self.vocab and (j == 0 or last[j] is not None) and self._follows(last[j], token):
                        if ended:
                            out.append(open_count[j] + 1)
                        else:
                            last[i], open_count[i] = token, open_count[j] + 1
                        break
        return out


def _byte_values() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PlainWords:
    """Counts of words of printable ASCII and the Latin letters up to U+024F by tiktoken, under a byte-level BPE of merges with a suffix at a word's end.

    tiktoken merges what is in the vocabulary when joined, the library only what its merges name. Both give the same if every token, left to the merges alone, becomes
    that token: as long as no merge has crossed its edges, its inside has gone the way it goes alone, so two neighbours that join to it are the pair that the merges name.
    That is tried out for every token. MARK stands for the suffix; a byte and MARK are joined before all else, since the library has them as one symbol.
    """

    MARK, END = "\x01", "\n"
    #: In normal form C, with a lower case of one letter up to U+02AF: no U+0130, U+023A or U+023E. Longer words (bytes) are left to the library.
    PLAIN, LONGEST = "^[!-~À-ÖØ-öø-įı-ȹȻ-Ƚȿ-ɏ]*$", 256
    _PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ʯ]+|[0-9]|[^a-zß-öø-ʯ0-9\n]+")

    def __init__(self, whole: dict):
        import tiktoken

        model, value = whole["model"], _byte_values()
        suffix, mark = model["end_of_word_suffix"], self.MARK.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank = {m: i for i, m in enumerate(merges)}

        def symbols(token: str) -> list[str]:
            bare = token.removesuffix(suffix)
            return list(bare) if bare == token else [*bare[:-1], bare[-1] + suffix]

        def alone(token: str) -> list[str]:
            own = symbols(token)
            while len(own) > 1:
                ranks = [rank.get(pair, len(rank)) for pair in zip(own, own[1:])]
                i = min(ranks)
                if i == len(rank):
                    break
                i = ranks.index(i)
                own[i : i + 2] = [own[i] + own[i + 1]]
            return own

        def raw(token: str) -> bytes:
            bare = token.removesuffix(suffix)
            return bytes(value[c] for c in bare) + (mark if bare != token else b"")

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + mark: 256 + b for b in range(256)}
        for i, (a, b) in enumerate(merges):
            token = raw(a + b)
            if mark[0] not in token[:-1] and token not in ranks:
                if alone(a + b) != [a + b]:
                    raise ValueError(f"the merges don't lead to {a + b!r}")
                ranks[token] = 512 + i
        self.special = [t["content"] for t in whole.get("added_tokens") or ()]
        self.encoding = tiktoken.Encoding("plain_words", pat_str=r"[^\x01\n]+\x01|\n", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, whole: dict, encode) -> PlainWords | None:
        """None where the file has other steps than these, or words that are tried out have other counts."""
        model = whole["model"]
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or odd or not model.get("end_of_word_suffix") or whole.get("normalizer") != _NORMAL or whole.get("pre_tokenizer") != _PIECES:
            return None
        try:
            own = cls(whole)
        except (KeyError, ValueError):
            return None
        tried = [t.removesuffix(model["end_of_word_suffix"]) for t in [*model["vocab"]][::16]] + ["it's", "IT'S'd''ll", "a1b22c", "ÀÉǅzǆ", "x,y;--z", "Straße", "þÞŊŋ'Ŀ"]
        tried = pa.array(tried, pa.large_string())
        tried = tried.filter(own.among(tried))
        return own if own.counts(tried).tolist() == encode(tried.to_pylist()) else None

    def among(self, words: pa.Array) -> pa.Array:
        """Which of the words these are."""
        plain = pc.and_(pc.match_substring_regex(words, self.PLAIN), pc.less_equal(pc.binary_length(words), self.LONGEST))
        for s in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, s)))
        return plain

    def counts(self, words: pa.Array) -> np.ndarray:
        """Counts of large strings, all of them such words."""
        out = [np.empty(0, np.int64)]
        for i in range(0, len(words), SLICE_WORDS):
            joined = pc.binary_join_element_wise(words[i : i + SLICE_WORDS], pa.scalar(self.END, words.type), pa.scalar("", words.type))
            text = str(memoryview(joined.buffers()[2])[: np.frombuffer(joined.buffers()[1], dtype=np.int64)[len(joined)]], "utf-8")
            marked = self._PIECE.sub(r"\g<0>" + self.MARK, text.lower())
            ends = np.flatnonzero(self.encoding.encode_to_numpy(marked, disallowed_special=()) == ord(self.END))
            out.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(out)


class PrefixCounter:
    """Token counts of prefixes under one tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.words: dict[str, int] = {"": 0}
        self.before: dict[str, int] = {}  # those remembered before; what is met again moves to words
        self.inner: dict[str, list[int]] = {}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.path, self.is_bpe, self._within = path, whole["model"].get("type") == "BPE", None
        self.special = [t["content"] for t in whole.get("added_tokens") or ()]
        self._try_out()
        self.plain = PlainWords.of(whole, self._encode)

    @property
    def within(self) -> WordPrefixes | None:
        """Merges and vocabulary as Python objects, which only cut words need: counts of whole texts go without their memory."""
        if self.is_bpe and self._within is None:
            with open(self.path, encoding="utf-8") as f:
                self._within = WordPrefixes(json.load(f)["model"])
        return self._within

    def _try_out(self) -> None:
        words = ["it's", "Word", "12ab", "--x", "ſé", "日本", "a'", "'ll", "\x0b!", *self.special, "z"]
        alone = self._encode(words)
        for gap in [*SEPARATORS, "  ", " \n\t"]:
            if len(self.tok.encode(gap + gap.join(words) + gap, add_special_tokens=False).ids) != sum(alone):
                raise ValueError("this vocabulary doesn't keep words apart at white space: their counts don't add up")

    def _encode(self, texts: list[str]) -> list[int]:
        """Count of each text alone: many are given at once, told apart by the library."""
        out = []
        for i in range(0, len(texts), 1000):
            part = texts[i : i + 1000]
            owner = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False).word_ids
            if None in owner:  # a token that the library assigns to no text
                out += [len(e.ids) for e in self.tok.encode_batch(part, add_special_tokens=False)]
            else:
                out += np.bincount(np.array(owner, dtype=np.int64), minlength=len(part)).tolist()
        return out

    def counts_of(self, words: list[str]) -> np.ndarray:
        """Counts of distinct words; those not too long are remembered."""
        if len(self.words) > CACHE_WORDS // 2:
            self.words, self.before = {"": 0}, self.words
        missing = [w for w in words if w not in self.words]
        found = {w: self.before[w] for w in missing if w in self.before}
        new = [w for w in missing if w not in found]
        found.update(zip(new, self._encode(new), strict=True))
        self.words.update((w, n) for w, n in found.items() if len(w) <= LONG_WORD)
        return np.fromiter((found[w] if w in found else self.words[w] for w in words), dtype=np.int64, count=len(words))

    def counts_in(self, words: pa.Array) -> np.ndarray:
        """Counts of distinct words, large strings: only those that aren't plain become Python strings."""
        if self.plain is None or not len(words):
            return self.counts_of(words.to_pylist())
        is_plain, out = self.plain.among(words), np.empty(len(words), dtype=np.int64)
        at = is_plain.to_numpy(zero_copy_only=False)
        out[at] = self.plain.counts(words.filter(is_plain))
        if not at.all():
            out[~at] = self.counts_of(words.filter(pc.invert(is_plain)).to_pylist())
        return out

    def _cells(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(offsets, pieces, counts) of a string array without nulls: text i has the entries offsets[i] to offsets[i + 1] - 1, one for each piece between single
        separators, which may be empty."""
        texts = texts.cast(pa.large_string())
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8).copy()
        raw[(raw == 9) | (raw == 10) | (raw == 13)] = 32
        flat = pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(raw), None, 0, texts.offset)
        split = pc.split_pattern(flat, " ")
        offsets = split.offsets.to_numpy()
        words = split.values[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        named = words.dictionary_encode()
        return offsets, words, self.counts_in(named.dictionary)[named.indices.to_numpy()] if len(words) else np.empty(0, np.int64)

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Counts of whole texts, a string array without nulls."""
        offsets, _, count = self._cells(texts)
        total = np.concatenate(([0], np.cumsum(count)))
        return np.diff(total[offsets])

    def tables(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, word_ends, prefix_tokens) of a string array without nulls: the ends of _cells() and the counts up to there."""
        offsets, words, count = self._cells(texts)
        chars = pc.utf8_length(words).to_numpy().astype(np.int64) + 1

        def along(x: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(x)))
            return total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))

        return offsets, along(chars) - 1, along(count)

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Character ends of the pieces of one text, and the counts of the prefixes that end there."""
        _, ends, counts = self.tables(pa.array([text]))
        return ends.tolist(), counts.tolist()

    def inside(self, word: str) -> list[int]:
        """Counts of all prefixes of a word, the empty one included."""
        if word not in self.inner:
            if len(self.inner) > 10_000:
                self.inner.clear()
            if self.within is None or not word.isascii() or "'" in word or any(s[:1] in word for s in self.special):
                self.inner[word] = [0, *self._encode([word[:i] for i in range(1, len(word) + 1)])]
            else:
                out, total = [0], 0
                for piece in re.findall(r"[a-z]+|[0-9]|[^a-z0-9\s]+|\s", word.lower()):
                    own = [0] if piece.isspace() else self.within.counts(piece)
                    out += [total + n for n in own]
                    total += own[-1]
                self.inner[word] = out
        return self.inner[word]

    def prefix(self, text: str, end: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """Count of text[:end] for any end, from the table and the prefixes of the one word that it cuts."""
        ends, counts = table or self.table(text)
        k = bisect_right(ends, end)
        before = counts[k - 1] if k else 0
        start = ends[k - 1] + 1 if k else 0
        if end <= start:
            return before
        return before + self.inside(_SPLIT.match(text, start).group())[end - start]

    def fit(self, text: str, budget: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """Characters of the longest prefix of whole words with at most budget tokens."""
        ends, counts = table or self.table(text)
        k = bisect_right(counts, budget)
        return ends[k - 1] if k else 0


def _counter(path: str) -> PrefixCounter:
    """The counter of this Python worker, so that later tasks find its table of words."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_strataspan_counters", {})
    if path not in held:
        held[path] = PrefixCounter(path)
    return held[path]


def _groups(sizes: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together."""
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def counting(path: str, whole: bool = True):
    """For mapInArrow over (doc_id, text): the rows of whole_counts(), or those of prefix_tables()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            for a, b in _groups(n_bytes):
                texts = pc.fill_null(batch.column(1)[a:b], "")
                if whole:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n_bytes[a:b]), pa.array(counter.totals(texts))], names=["doc_id", "n_bytes", "n_tokens"])
                    continue
                offsets, ends, tokens = counter.tables(texts)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (ends, tokens)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n_bytes[a:b]), *lists], names=["doc_id", "n_bytes", "word_ends", "prefix_tokens"])

    return run


def prefix_tables(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes, word_ends (characters) and prefix_tokens of each row of docs (doc_id, text): a cell for each piece between single separators, which
    says where it ends and how many tokens the text has up to there."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(counting(tokenizer_path, False), "doc_id long, n_bytes long, word_ends array<int>, prefix_tokens array<int>")


def whole_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of docs (doc_id, text): the last cells of the tables alone."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counting(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")


def stored_tables(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """prefix_tables(), written once; cells are stored as differences."""
    return Scratch(docs.sparkSession, "token_counts").put(prefix_tables(docs, tokenizer_path), "tables", {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"})


def n_tokens() -> Column:
    """Tokens of the whole text, from a table's columns."""
    return F.element_at("prefix_tokens", -1).cast("long")


def words_within(budget: Column | int) -> Column:
    """Pieces of the longest prefix with at most budget tokens, from a table's columns."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.when(n_tokens() <= limit, F.size("prefix_tokens")).otherwise(F.size(F.filter("prefix_tokens", lambda n: n <= limit)))


def chars_within(budget: Column | int) -> Column:
    """Characters of the longest prefix of whole words with at most budget tokens, from a table's columns: where to truncate."""
    k = words_within(budget)
    return F.when(k > 0, F.get("word_ends", k - 1)).otherwise(0).cast("long")


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    import public_tokenizers

    tables = stored_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(tokenizer))
    return tables.select("doc_id", "n_bytes", n_tokens().alias("n_tokens"), (n_tokens() > limit).alias("over_limit"), chars_within(limit).alias("chars_within"))
