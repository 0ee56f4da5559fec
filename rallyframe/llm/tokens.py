"""Token counts by offset-mapped attribution."""

from __future__ import annotations

import base64
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, made_schema, shipped, without

#: A public byte-level vocabulary in rank format: base64 token, space, rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's own tokenizer cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the pattern's white space. The matcher gives up on runs of about
#: a million, so runs longer than ``LONG_RUN`` are cut out where it would cut.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 100_000
RULES = ("start", "end", "most")
#: Between the fields of a document, when several are encoded as one text.
JOINT = "\n"

_encoders: dict = {}


def encoder(vocabulary: bytes):
    """A tokenizer for the vocabulary file's content, and its tokens' lengths in bytes."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[key]


def encode(encoding, text: str, long_run: int = LONG_RUN) -> np.ndarray:
    """The text's tokens, as of one pass over all of it.

    The pattern takes a run of white space as one piece, less its last character
    if text follows, which then begins the next piece. Nothing in it looks back,
    so long runs are encoded as that piece and the text between them apart.
    """
    out, at = [], 0
    for m in re.finditer(f"{WHITE}{{{long_run},}}", text):
        stop = m.end() - (m.end() < len(text))
        if stop > m.start():
            out += [encoding.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(encoding._encode_single_piece(text[m.start() : stop].encode()), dtype=np.uint32)]
            at = stop
    out.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(out).astype(np.int64)


def attribute(ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, by an interval join of token and section spans.

    Both tile the text, so a span is known by its end and spans are found by
    binary search. A token that crosses a boundary goes whole to one section:
    to that of its first byte (start), of its last byte (end), or of most of
    its bytes, the earlier one at a tie (most).
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, ends - 1, side="right")
    if rule == "start":
        owner = first
    elif rule == "end":
        owner = last
    else:
        owner = first.copy()
        for i in np.flatnonzero(first != last):
            spans = range(first[i], last[i] + 1)
            held = [min(ends[i], section_ends[k]) - max(starts[i], section_ends[k - 1] if k else 0) for k in spans]
            owner[i] = first[i] + int(np.argmax(held))
    return np.bincount(owner, minlength=len(section_ends))


def line_ends(raw: bytes) -> np.ndarray:
    """Ends of the lines of UTF-8 text, each with its line feed; one at least."""
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def count_batches(batches, vocabulary, fields: int, rule: str):
    """(row, fields...) -> (row, sections) with sections an array of (field,
    section, start, end, n_tokens); start and end in code points."""
    encoding, lengths = encoder(vocabulary.value)
    for batch in batches:
        columns = [batch.column(1 + i).to_pylist() for i in range(fields)]
        made: list[list[np.ndarray]] = [[] for _ in range(5)]
        sizes = []
        for row in zip(*columns, strict=True):
            # A field's last section holds the joint after it.
            texts = [(x or "") + (JOINT if i + 1 < fields else "") for i, x in enumerate(row)]
            raws = [x.encode() for x in texts]
            ends, base, cuts = np.cumsum(lengths[encode(encoding, "".join(texts))]), 0, []
            for field, raw in enumerate(raws):
                at = line_ends(raw if field + 1 == fields else raw[:-1])
                if field + 1 < fields:
                    at = at.copy()
                    at[-1] = len(raw)
                # Code points before each byte: bytes that do not continue a character.
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
                stops = chars[np.minimum(at, len(raw))]
                for out, values in zip(made, (np.full(len(at), field), np.arange(len(at)), np.concatenate(([0], stops[:-1])), stops), strict=False):
                    out.append(values)
                cuts.append(at + base)
                base += len(raw)
            cuts = np.concatenate(cuts)
            made[4].append(attribute(ends, cuts, rule))
            sizes.append(len(cuts))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        flat = [pa.array(np.concatenate(m) if m else np.zeros(0), k) for m, k in zip(made, kinds, strict=True)]
        sections = pa.StructArray.from_arrays(flat, ["field", "section", "start", "end", "n_tokens"])
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, sections)], ["_row", "sections"])


def read_vocabulary(path: str) -> bytes:
    """The file's content; about a megabyte, whatever the data's size."""
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), carry: tuple[str, ...] = ("doc_id",), rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per section of each row of ``docs``: ``carry``, field, section,
    start, end, n_tokens.

    A row's fields are joined by line feeds and encoded once, as a whole; its
    lines are its sections, numbered within each field. Tokens are laid over
    the lines by their spans, and one that crosses a boundary goes to a single
    line by ``rule``, so a row's counts add up to its tokens. Null and empty
    fields are one section without text (its joint may hold a token). Repeated
    rows each get their sections; an empty table gives none. A carried column
    with the name of a result is left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    known = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    carry, n = without(carry, "field", "section", "start", "end", "n_tokens"), len(fields)
    row = F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("_row")
    given = docs.select(row, *[F.col(f"`{f}`").cast("string").alias(f"_field{i}") for i, f in enumerate(fields)])
    schema = made_schema(given, ["_row"], sections="array<struct<field:int,section:int,start:bigint,end:bigint,n_tokens:bigint>>")
    made = given.mapInArrow(lambda it: count_batches(it, known, n, rule), schema)
    names = F.array(*[F.lit(f) for f in fields])
    each = made.select("_row", F.explode("sections").alias("_s"))
    return each.select(*[F.col("_row")[c].alias(c) for c in carry], F.get(names, F.col("_s.field")).alias("field"), *[F.col(f"_s.{c}") for c in ("section", "start", "end", "n_tokens")])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token across lines goes to that of
    its first byte. Null and empty texts are one line of none; repeated rows each
    get their lines."""
    return token_counts(documents(spark, sf_dir)).drop("field")


shipped(sys.modules[__name__])
