"""Token counts with a digest cache, and the memoised encoder that packing uses as well."""

from __future__ import annotations

import hashlib
import json
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, map_batches
from foliant.session import scratch_path, written

#: Fixed value: the split pattern of tokenizers that encode every blank-free run by itself.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distinct words a worker remembers; when they are reached it keeps the short ones, which come again most often.
#: Results do not depend on it.
MEMO_WORDS = 1_000_000
SHORT_WORD = 9
_LOADED: dict[str, Encoder] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file, part of every cache key."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Encoder:
    """Ids of whole texts as 32-bit little-endian bytes, exactly as the library gives them.

    When the tokenizer drops blanks and never joins across them, words are encoded once and remembered. A text that
    holds the string of a special token always goes to the library as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces = None
        self.by_word = False
        self.memo: dict[bytes, bytes] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        splits = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            splits[0].get("pattern", {}).get("Regex") == WORD_SPLIT
            and splits[0].get("behavior") == "Removed"
            and kinds == ["NFC", "Replace", "Lowercase"]
        )
        self.special = [t["content"].encode() for t in config.get("added_tokens", [])]
        if self.by_word:
            end, vocabulary = config["model"]["end_of_word_suffix"], config["model"]["vocab"]
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(end)]] = True

    def encode(self, text: str) -> bytes:
        if self.pieces is not None:
            return array("I", self.pieces.encode(text)).tobytes()
        if not self.by_word:
            return self._whole(text)
        raw = text.encode()
        # A-Z may be lowered first unless a combining mark follows some letter: the marks change what NFC composes.
        lowered = raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()
        if any(s in raw or s in lowered for s in self.special):
            return self._whole(text)
        words = lowered.split()
        ids = list(map(self.memo.get, words))
        if None in ids:
            self._learn(words, {w for w, known in zip(words, ids) if known is None})
            ids = map(self.memo.get, words)
        return b"".join(ids)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[bytes], missing: set[bytes]) -> None:
        if len(self.memo) + len(missing) > MEMO_WORDS:
            kept = {w: ids for w, ids in self.memo.items() if len(w) <= SHORT_WORD}
            self.memo = kept if 2 * len(kept) <= MEMO_WORDS else {}
            missing = {w for w in words if w not in self.memo}
        # A full stop or comma after an ASCII letter or digit is a token run of its own.
        ended = {w for w in missing if len(w) > 1 and w[-1] in b".," and (97 <= w[-2] <= 122 or 48 <= w[-2] <= 57)}
        plain = [w for w in (missing - ended | {w[:-1] for w in ended} | {b".", b","}) if w not in self.memo]
        texts = [w.decode() for w in plain]
        letters = [(w, t) for w, t in zip(plain, texts) if t.isalpha()]
        if letters and not self._learn_letters(letters):
            letters = []
        others = [(w, t) for w, t in zip(plain, texts) if not (letters and t.isalpha())]
        for (word, _), e in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)):
            self.memo[word] = array("I", e.ids).tobytes()
        for w in ended:
            self.memo[w] = self.memo[w[:-1]] + self.memo[w[-1:]]


    def _learn_letters(self, words: list[tuple[bytes, str]]) -> bool:
        """Encode words of letters as one text; each ends with its only end-of-word token. False if that fails to add up."""
        ids = np.array(self.tokenizer.encode(" ".join(t for _, t in words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return False
        raw, at = ids.tobytes(), 0
        for (word, _), end in zip(words, (4 * ends).tolist()):
            self.memo[word] = raw[at:end]
            at = end
        return True


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def content_digest(text: str = "text"):
    """Digest of the normalised content: NULL as empty. Tokenizers see every other difference, so nothing else is folded."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``).

    ``cache`` is a folder of stored counts (version, digest, n_tokens), made when missing. Contents whose digest has
    no stored count for this tokenizer version are encoded once, by the row with the smallest id, and appended.
    NULL text counts as empty; repeated rows are all returned; an empty table appends nothing. Only (id, digest) rows
    are grouped, so a text that a third of all rows share is no hot key: its single chosen row carries the text.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = written(docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), content_digest().alias("digest")), "token-keys")
    schema = "version string, digest string, n_tokens bigint"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)  # the folder exists from now on
    known = spark.read.schema(schema).parquet(cache).where(F.col("version") == version).select("digest")
    wanted = keys.join(known, "digest", "left_anti").groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("chosen"))

    def encode(batches: Batches) -> Batches:
        enc = encoder(tokenizer)
        for b in batches:
            counts = [len(enc.encode(t)) // 4 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts)), b["digest"], pa.array(counts, pa.int64())], ["version", "digest", "n_tokens"]
            )

    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("chosen"), text.alias("text"))
    picked = texts.join(wanted.hint("shuffle_hash"), "chosen").where(content_digest() == F.col("digest")).select("digest", "text")
    map_batches(picked, encode, schema).write.mode("append").parquet(cache)
    stored = spark.read.schema(schema).parquet(cache).where(F.col("version") == version)
    # Runs at the same time may have stored a count twice. Written down, the counts are joined by a plain scan, so that
    # adaptive execution can split the rows of a very common text.
    counts = written(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark) -> str:
    """A cache folder of its own below the shared folder."""
    return scratch_path(spark, "token-cache")
