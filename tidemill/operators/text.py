"""Text: what to do with bytes that aren't UTF-8, tokens, special ids, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.media import text_windows

NAMES = {"bos": ["<s>", "<bos>", "[BOS]", "<|startoftext|>", "<|begin_of_text|>", "[CLS]"], "eos": ["</s>", "<eos>", "[EOS]", "<|endoftext|>", "<|end_of_text|>", "[SEP]"]}


def decoded(rows: DataFrame, payload: str = "payload", policy: str = "error") -> DataFrame:
    """rows with text: error fails on bytes that aren't UTF-8, skip leaves their rows out."""
    if policy not in ("error", "skip"):
        raise ValueError(f"a policy is error or skip, not {policy!r}")
    raw = F.col(payload).cast("string")
    if policy == "skip":
        return rows.filter(F.is_valid_utf8(raw)).withColumn("text", raw)
    return rows.withColumn("text", F.validate_utf8(raw))


class Words:
    """A vocabulary of whole words, parted by white space."""

    def __init__(self, vocabulary: dict[str, int], unknown: str = "[UNK]", pad_id: int | None = None):
        self.vocabulary, self.unknown, self.pad_id = vocabulary, vocabulary.get(unknown), pad_id

    def encode(self, text: str) -> list[int]:
        found = [self.vocabulary.get(w, self.unknown) for w in text.split()]
        if None in found:
            raise ValueError("a word isn't in the vocabulary, which has none for unknown ones")
        return found

    def id_of(self, name: str) -> int | None:
        return self.vocabulary.get(name)


class Library:
    """A tokenizer.json as the tokenizers library reads it; special tokens are not added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        self.made = None
        padding = self._tokenizer().padding
        self.pad_id = padding["pad_id"] if padding else None

    def _tokenizer(self):
        if self.made is None:
            from tokenizers import Tokenizer

            self.made = Tokenizer.from_str(self.json)
        return self.made

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def encode(self, text: str) -> list[int]:
        return self._tokenizer().encode(text, add_special_tokens=False).ids

    def id_of(self, name: str) -> int | None:
        return self._tokenizer().token_to_id(name)


def special_id(tokenizer, kind: str, name: str | None = None) -> int:
    """The id of the given name, or of the first usual one that the vocabulary has; none is an error."""
    for n in [name] if name else NAMES[kind]:
        if (found := tokenizer.id_of(n)) is not None:
            return found
    raise ValueError(f"the vocabulary has no {kind} token{f' {name}' if name else ''}")


def pad_id(tokenizer, eos: int | None) -> int:
    """The tokenizer's own, else the end's, else 0."""
    return tokenizer.pad_id if tokenizer.pad_id is not None else eos if eos is not None else 0


def tokenised(rows: DataFrame, encode: Callable[[str], list[int]], text: str = "text", ids: str = "ids") -> DataFrame:
    """rows with ids (array of long) in place of text; encode is shipped to the workers, which call it batch by batch."""
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([encode(x or "") for x in b.column(len(others)).to_pylist()], pa.list_(pa.int64()))], names=[*others, ids])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*others).schema)
    return rows.select(*others, text).mapInArrow(run, f"{fields}{ids} array<long>")


def bounded(ids: Column, bos: int | None, eos: int | None) -> Column:
    one = lambda x: [F.array(F.lit(x).cast("long"))] if x is not None else []
    return F.concat(*one(bos), ids, *one(eos))


def windows(rows: DataFrame, width: int, stride: int | None = None, pad: int = 0, truncate: str = "right", ids: str = "ids") -> DataFrame:
    """(.., window_no, token_ids, mask). truncate: right goes on in further windows and loses nothing; error fails where ids don't fit into one."""
    if width <= 0 or (stride is not None and stride <= 0):
        raise ValueError("width and stride are over 0")
    if truncate not in ("right", "error"):
        raise ValueError(f"truncate is right or error, not {truncate!r}")
    if truncate == "error":
        over = F.raise_error(F.concat(F.lit("a text has more tokens than a window: "), F.size(ids).cast("string"))).cast("array<long>")
        rows = rows.withColumn(ids, F.when(F.size(ids) > width, over).otherwise(F.col(ids)))
    return text_windows(rows, ids, width, stride or width, pad)


def rows_of_text(rows: DataFrame, tokenizer, width: int, stride: int | None = None, bos: bool = False, eos: bool = True, truncate: str = "right", policy: str = "error") -> DataFrame:
    """The whole way from payloads to windows; (.., window_no, token_ids, mask), a sample's id once for each of its windows."""
    first, last = (special_id(tokenizer, "bos") if bos else None), (special_id(tokenizer, "eos") if eos else None)
    ids = tokenised(decoded(rows, policy=policy).drop("payload"), tokenizer.encode)
    return windows(ids.withColumn("ids", bounded(F.col("ids"), first, last)), width, stride, pad_id(tokenizer, last), truncate)
