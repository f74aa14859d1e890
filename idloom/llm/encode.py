"""Encoding of the whole corpus with a public byte-level BPE tokenizer by tree concatenation.

Every text longer than a segment is cut, within a word wherever one is near, the segments are encoded on their own, and
neighbours are joined pairwise up a tree of halves: a window of tokens around each join is encoded anew and grown until
it begins and ends with the tokens that both sides already have. Only where no word is near, the cut lies at a place
where the tokenizer splits anyway, which needs no repair. The segments of very long texts are spread over the cluster.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

#: Where the vocabulary files lie on every machine; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokenizer of the byte-level BPE vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a segment.
SEGMENT = 512
#: Characters before a segment's end within which a cut in a word is sought.
REACH = 64
#: Characters of the pieces in which longer texts are spread over the cluster; a matter of placement only.
SPREAD = 1 << 16

_WORD = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}"))
_KIND = regex.compile(r"(?P<s>\p{White_Space})|(?P<l>\p{L})|(?P<n>\p{N})|(?P<o>.)", regex.DOTALL)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a ranks file; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _safe(a: str, b: str) -> bool:
    """Whether the tokenizer always splits between the neighbours a and b: a is no blank, and b is a blank or another
    kind of character (an apostrophe may begin a contraction and joins what follows)."""
    ka, kb = _kind(a), _kind(b)
    return ka != "s" and ka != kb and (kb == "s" or a != "'")


def _kind(c: str) -> str:
    return _KIND.match(c).lastgroup


def _inside(text: str, p: int) -> bool:
    """Whether p lies within a word, far enough from its ends that no contraction and no blank takes part in the cut."""
    near = text[p - 3 : p + 2]
    return near.isalpha() or len({_kind(c) for c in near}) == 1 and _kind(near[0]) != "s"


def cut_points(text: str, size: int) -> list[tuple[int, bool]]:
    """(place, safe) of the cuts of a text into segments of at most about ``size`` characters: the last place within a word
    near each segment's end, else the last safe place of its second half. A run of blanks is left whole."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        end = min(at + size, n - 2)
        low = at + max(size // 2, 3)
        for p in range(end, max(low, end - REACH), -1):
            if _inside(text, p):
                out.append((p, False))
                break
        else:
            for p in range(end, low, -1):
                if _safe(text[p - 1], text[p]):
                    out.append((p, True))
                    break
                if _inside(text, p):
                    out.append((p, False))
                    break
            else:
                p = end + 1
                while p < n and not _safe(text[p - 1], text[p]):
                    p += 1
                if p >= n:
                    return out
                out.append((p, True))
        at = out[-1][0]
    return out


def _word_tokens(enc, text: str, last: bool) -> int:
    """Tokens of the first or last word of a segment, within which a join may reach."""
    if not last:
        return len(enc._encode_single_piece(_WORD.match(text).group()))
    # A blank after another character always begins a word, so the last word is found from the last such place.
    p = len(text) - 1
    while p > 0 and not (text[p].isspace() and not text[p - 1].isspace()):
        p -= 1
    *_, m = _WORD.finditer(text, p)
    return len(enc._encode_single_piece(m.group()))


def join_tokens(enc, left: list[int], left_limit: int, right: list[int], right_limit: int) -> list[int]:
    """The tokens of the concatenation of two encoded halves of one word.

    Re-encodes k tokens of each side, k = 4, 8, 16 ..., until the result begins with the window's first and ends with its
    last token; a BPE encoding whose neighbours agree pairwise is the encoding of the whole, so both halves then hold
    outside the window. The limits are the tokens each half has within the word; at them a side's edge is the word's own.
    """
    k = 4
    while True:
        a, b = min(k, left_limit), min(k, right_limit)
        head, tail = left[len(left) - a :], right[:b]
        window = enc._encode_single_piece(enc.decode_bytes(head + tail)) if head or tail else []
        if (a == left_limit or window[0] == head[0]) and (b == right_limit or window[-1] == tail[-1]):
            return left[: len(left) - a] + window + right[b:]
        if a == left_limit and b == right_limit:
            return left[: len(left) - a] + window + right[b:]
        k *= 2


def encode_segments(enc, parts: list[tuple[list[int], bool, int, int, bool]]) -> list[int]:
    """Concatenate encoded segments (tokens, safe cut before, first word's tokens, last word's tokens, is one word) as a
    tree of halves."""
    if len(parts) == 1:
        return parts[0][0]
    while len(parts) > 1:
        nxt = []
        for i in range(0, len(parts) - 1, 2):
            (t1, s1, f1, l1, o1), (t2, s2, f2, l2, o2) = parts[i], parts[i + 1]
            if s2:
                nxt.append((t1 + t2, s1, f1, l2, False))
                continue
            t = join_tokens(enc, t1, l1, t2, f2)
            grown = len(t) - (len(t1) - l1) - (len(t2) - f2)  # tokens of the joined word
            nxt.append((t, s1, grown if o1 else f1, grown if o2 else l2, o1 and o2))
        if len(parts) % 2:
            nxt.append(parts[-1])
        parts = nxt
    return parts[0][0]


def _part(enc, text: str, safe: bool, open_end: bool, size: int = 0) -> tuple[list[int], bool, int, int, bool]:
    tokens = encode_text(enc, text, size) if size else enc.encode_ordinary(text)
    first = len(tokens) if not tokens or safe else _word_tokens(enc, text, False)
    last = len(tokens) if not tokens or not open_end else _word_tokens(enc, text, True)
    one = bool(tokens) and not safe and first == len(tokens) or bool(tokens) and open_end and last == len(tokens)
    return tokens, safe, first, last, one


def encode_text(enc, text: str | None, size: int = SEGMENT) -> list[int]:
    """The ids of one text, segment by segment; null and empty texts have none."""
    if not text:
        return []
    cuts = cut_points(text, size)
    if not cuts:
        return enc.encode_ordinary(text)
    starts = [(0, True), *cuts]
    ends = [*[c for c, _ in cuts], len(text)]
    opens = [*[not s for _, s in cuts], False]
    return encode_segments(enc, [_part(enc, text[a:b], s, o) for (a, s), b, o in zip(starts, ends, opens, strict=True)])


def _str(x) -> str:
    return bytes(x).decode("utf-8", "replace")


def _encoded(df: DataFrame, text: str, name: str, kind: DataType, finish: Callable[[list[int]], object], path: str, size: int, spread: int) -> DataFrame:
    """``df`` without ``text``, plus ``finish`` of each text's ids as column ``name``.

    Texts of at most ``spread`` characters are encoded where they are read, without a shuffle. Longer ones are cut into
    pieces, which are spread over the cluster and encoded in parallel, and joined per row.
    """
    kept = [f.name for f in df.schema.fields if f.name != text]
    rows = df.select(F.struct(*kept).alias("_kept"), F.col(text).cast("binary").alias("_t"), F.coalesce(F.length(F.col(text)) > spread, F.lit(False)).alias("_long"))
    kept_field = StructField("_kept", rows.schema["_kept"].dataType)
    arrow = {ArrayType: pa.list_(pa.int32()), LongType: pa.int64()}[type(kind)]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            got = [finish(encode_text(enc, _str(t), size)) if t else finish([]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, arrow)], ["_kept", name])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (row, t) in enumerate(zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)):
                s = _str(t)
                starts = [(0, True), *cut_points(s, spread)]
                ends = [c for c, _ in starts[1:]] + [len(s)]
                n = len(starts)
                opens = [not safe for _, safe in starts[1:]] + [False]
                parts = [s[a:e] for (a, _), e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i] + [None] * (n - 1), pa.int64())), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([x for _, x in starts], pa.bool_()), pa.array(opens, pa.bool_()), pa.array(parts, pa.string())],
                    ["_kept", "_row", "_no", "_safe", "_open", "_seg"],
                )

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            got = [_part(enc, t, safe, o, size) for t, safe, o in zip(b.column(5).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            cols = [pa.array([g[0] for g in got], pa.list_(pa.int32())), *[pa.array([g[k] for g in got], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.bool_()))]]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(4)], *cols], ["_kept", "_row", "_no", "_safe", "_ids", "_first", "_last", "_one"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            got = [finish(encode_segments(enc, [(p["_ids"], p["_safe"], p["_first"], p["_last"], p["_one"]) for p in parts])) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, arrow)], ["_kept", name])

    result = StructType([kept_field, StructField(name, kind)])
    near = rows.where("not _long").select("_kept", "_t").mapInArrow(short, result)
    head = [kept_field, StructField("_row", LongType()), StructField("_no", IntegerType()), StructField("_safe", BooleanType())]
    far = rows.where("_long").select("_kept", "_t", F.monotonically_increasing_id().alias("_row"))
    far = far.mapInArrow(pieces, StructType([*head, StructField("_open", BooleanType()), StructField("_seg", StringType())])).repartition("_row", "_no")
    far = far.mapInArrow(encode_pieces, StructType([*head, StructField("_ids", ArrayType(IntegerType())), StructField("_first", IntegerType()), StructField("_last", IntegerType()), StructField("_one", BooleanType())]))
    far = far.groupBy("_row").agg(F.first("_kept", ignorenulls=True).alias("_kept"), F.array_sort(F.collect_list(F.struct("_no", "_ids", "_safe", "_first", "_last", "_one"))).alias("_parts"))
    far = far.select("_kept", "_parts").mapInArrow(whole, result)
    return near.unionByName(far).select(*[F.col("_kept")[c].alias(c) for c in kept], name)


def encode_corpus(df: DataFrame, doc_id: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, size: int = SEGMENT, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every text without special tokens; null and empty texts have an empty list.

    Every text is cut into segments of ``size`` characters that are joined by tree concatenation; a shorter text is one
    segment. Repeated ids of rows are rows of their own. Texts that spell special tokens are ordinary text; bytes that
    are no UTF-8 become U+FFFD.
    """
    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return _encoded(rows, "_text", "ids", ArrayType(IntegerType()), list, f"{tokenizers}/{vocabulary}", size, spread).withColumnRenamed("_id", doc_id)


def token_counts(df: DataFrame, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, size: int = SEGMENT, spread: int = SPREAD) -> DataFrame:
    """``df`` without ``text``, plus ``n_tokens``; null and empty texts have 0. Long texts are encoded in parallel pieces."""
    return _encoded(df, text, "n_tokens", LongType(), len, f"{tokenizers}/{vocabulary}", size, spread)
