"""Edit-aware token counting with pre-token segment trees.

A byte-pair tokenizer never merges across pre-tokens, so a text's count is the
sum of its pre-tokens' counts. A document's tree has leaves of consecutive
pre-tokens of about ``LEAF_CHARS`` characters, each with its characters and
tokens, and inner nodes with the sums of their two children. ``build`` gives a table of trees,
which is kept beside the texts; ``apply`` takes such a table and a table of edits and
gives the trees after them. An edit splices
the text; the tree is split at the leaves it touches and a little context before it, that region is split
into pre-tokens again up to the first old leaf bound beyond the edit at which a new pre-token
also begins, and its new leaves are joined to what is left and right. Only the region is encoded, and
only the nodes above its borders are new, in the order of the tree's height: trees are balanced by height
and nodes are never changed, so all others are used as they are.

The vocabulary is a tiktoken rank file whose path is a parameter. Workers remember the
counts of frequent pre-tokens.

Defined results: null and empty texts have no leaf and 0 tokens; edits of
them are applied to an empty text. Edit positions beyond the text count as its
end, negative ones as its beginning. Edits of a document are applied by their number, equal numbers by their
values; those without a document, and documents without edits, change nothing. Repeated rows are counted and edited alike.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Where the rank file of the query lies.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS, REMEMBERED = 256, 300_000
#: A pre-token depends on so many characters after its end at most (a contraction is looked for).
LOOK_AHEAD = 4


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts of pre-tokens under one rank file."""

    def __init__(self, path: str) -> None:
        self.encoding, self.pattern, self.known = encoding(path), regex.compile(PATTERN), {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of consecutive leaves."""
        chars, tokens, c, t = [], [], 0, 0
        known, count = self.known.get, self.count
        for piece in self.pieces(text):
            n = known(piece)
            t += count(piece) if n is None else n
            c += len(piece)
            if c >= LEAF_CHARS:
                chars.append(c)
                tokens.append(t)
                c = t = 0
        if c:
            chars.append(c)
            tokens.append(t)
        return chars, tokens


NONE = -1
#: Columns of a tree's nodes.
NODES = ("chars", "tokens", "left", "right", "height")


@dataclass
class Tree:
    """A text with its tree; ``encoded`` counts the characters that edits had encoded again, ``made`` the nodes they made."""

    text: str
    chars: list[int] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    height: list[int] = field(default_factory=list)
    root: int = NONE
    encoded: int = 0
    made: int = 0

    @classmethod
    def build(cls, text: str, counter: Counter) -> Tree:
        out = cls(text)
        out.root = out._over(*counter.leaves(text))
        return out

    @property
    def total(self) -> int:
        return self.tokens[self.root] if self.root != NONE else 0

    def _node(self, chars: int, tokens: int, left: int = NONE, right: int = NONE, height: int = 0) -> int:
        for column, value in zip((self.chars, self.tokens, self.left, self.right, self.height), (chars, tokens, left, right, height), strict=True):
            column.append(value)
        self.made += 1
        return len(self.chars) - 1

    def _inner(self, a: int, b: int) -> int:
        return self._node(self.chars[a] + self.chars[b], self.tokens[a] + self.tokens[b], a, b, 1 + max(self.height[a], self.height[b]))

    def _over(self, chars: list[int], tokens: list[int]) -> int:
        """A tree over new leaves."""
        level = [self._node(c, t) for c, t in zip(chars, tokens, strict=True)]
        while len(level) > 1:
            pairs = [self._inner(level[k], level[k + 1]) for k in range(0, len(level) - 1, 2)]
            if len(level) % 2:
                pairs.append(self._join(pairs.pop(), level[-1]))
            level = pairs
        return level[0] if level else NONE

    def _join(self, a: int, b: int) -> int:
        """One balanced tree of the leaves of two, in their order."""
        if NONE in (a, b):
            return max(a, b)
        if self.height[a] > self.height[b] + 1:
            outer, inner = self.left[a], self._join(self.right[a], b)
            if self.height[inner] <= self.height[outer] + 1:
                return self._inner(outer, inner)
            low, high = self.left[inner], self.right[inner]
            if self.height[low] <= self.height[high]:
                return self._inner(self._inner(outer, low), high)
            return self._inner(self._inner(outer, self.left[low]), self._inner(self.right[low], high))
        if self.height[b] > self.height[a] + 1:
            inner, outer = self._join(a, self.left[b]), self.right[b]
            if self.height[inner] <= self.height[outer] + 1:
                return self._inner(inner, outer)
            low, high = self.left[inner], self.right[inner]
            if self.height[high] <= self.height[low]:
                return self._inner(low, self._inner(high, outer))
            return self._inner(self._inner(low, self.left[high]), self._inner(self.right[high], outer))
        return self._inner(a, b)

    def _split(self, node: int, chars: int) -> tuple[int, int]:
        """The leaves that end within the first ``chars`` characters, and the others."""
        if node == NONE:
            return NONE, NONE
        a, b = self.left[node], self.right[node]
        if a == NONE:
            return (node, NONE) if self.chars[node] <= chars else (NONE, node)
        if chars >= self.chars[a]:
            one, two = self._split(b, chars - self.chars[a])
            return self._join(a, one), two
        one, two = self._split(a, chars)
        return one, self._join(two, b)

    def leaves(self, node: int | None = None) -> Iterator[int]:
        """Leaves in order, found as they are asked for."""
        todo = [self.root if node is None else node]
        while todo:
            k = todo.pop()
            if k == NONE:
                continue
            if self.left[k] == NONE:
                yield k
            else:
                todo += (self.right[k], self.left[k])

    def edit(self, start: int, end: int, new: str, counter: Counter) -> None:
        """Replace text[start:end] by ``new``."""
        start = min(max(start, 0), len(self.text))
        end = min(max(start, end), len(self.text))
        before, rest = self._split(self.root, start - LOOK_AHEAD)
        at = self.chars[before] if before != NONE else 0
        self.text = self.text[:start] + new + self.text[end:]
        shift, begin = len(new) - (end - start), start + len(new)
        # old leaf bounds, where beyond the edit the text after them is what it was
        bounds, bound = self.leaves(rest), at
        chars, tokens, c, t, pos, met = [], [], 0, 0, at, False
        for m in counter.pattern.finditer(self.text, at):
            while bound != NONE and (bound < end or bound + shift < pos or bound == at):
                leaf = next(bounds, NONE)
                bound = bound + self.chars[leaf] if leaf != NONE else NONE
            if pos >= begin and bound + shift == pos and bound != NONE:
                met = True
                break
            piece = m.group()
            c, t, pos = c + len(piece), t + counter.count(piece), m.end()
            if c >= LEAF_CHARS:
                chars.append(c)
                tokens.append(t)
                c = t = 0
        if c:
            chars.append(c)
            tokens.append(t)
        self.encoded += pos - at
        after = self._split(rest, bound - at)[1] if met else NONE
        self.root = self._join(self._join(before, self._over(chars, tokens)), after)

    def compact(self) -> None:
        """Leave out nodes of earlier trees once they are most."""
        used = sum(1 for _ in self.leaves())
        if len(self.chars) > 8 * used:
            leaves = list(self.leaves())
            chars, tokens = [self.chars[k] for k in leaves], [self.tokens[k] for k in leaves]
            for name in NODES:
                setattr(self, name, [])
            self.root = self._over(chars, tokens)


FIELDS = "text string, chars array<int>, tokens array<int>, left array<int>, right array<int>, height array<int>, root int"


def build(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and the tree of each row's text: text, the columns of its nodes and the root's number."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                yield _rows(batch["doc_id"], [Tree.build(text or "", counter) for text in batch["text"].to_pylist()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, f"doc_id long, {FIELDS}")


#: Rows that are worked on at once.
ROWS = 500


def _rows(ids: pa.Array, trees: list[Tree], *more: tuple[str, list[int]]) -> pa.RecordBatch:
    lists = [pa.array([getattr(t, name) for t in trees], pa.list_(pa.int32())) for name in NODES]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([t.text for t in trees], pa.string()), *lists, pa.array([t.root for t in trees], pa.int32()), *(pa.array(v, pa.int64()) for _, v in more)],
        ["doc_id", "text", *NODES, "root", *(n for n, _ in more)],
    )


def apply(trees: DataFrame, edits: DataFrame | None = None, ranks: str = RANKS) -> DataFrame:
    """The trees after their documents' edits, with tokens_before, leaves_before, encoded_chars (the characters that were encoded again) and made_nodes.

    ``edits`` has doc_id, number, start, end, new; without it each row of ``trees`` brings an array ``edits`` of (number, start, end, new).
    """
    held = trees
    if edits is not None:
        some = edits.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        held = trees.join(some.agg(F.sort_array(F.collect_list(F.struct("number", "start", "end", "new"))).alias("edits")), "doc_id", "left")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch, out, before = whole.slice(first, ROWS), [], []
                for text, *nodes, root, own in zip(*(batch[c].to_pylist() for c in ("text", *NODES, "root", "edits")), strict=True):
                    tree = Tree(text, *nodes, root)
                    before.append((tree.total, sum(1 for _ in tree.leaves())))
                    for e in own or ():
                        tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "", counter)
                    made = tree.made
                    tree.compact()
                    tree.made = made
                    out.append(tree)
                more = ([n for n, _ in before], [n for _, n in before], [t.encoded for t in out], [t.made for t in out])
                yield _rows(batch["doc_id"], out, *zip(("tokens_before", "leaves_before", "encoded_chars", "made_nodes"), more, strict=True))

    columns = held.select("doc_id", "text", *NODES, "root", "edits")
    return columns.mapInArrow(change, f"doc_id long, {FIELDS}, tokens_before long, leaves_before long, encoded_chars long, made_nodes long")


def n_tokens() -> Column:
    """Tokens of a tree's row."""
    return F.coalesce(F.get("tokens", F.col("root")), F.lit(0)).cast("long")


def sample_edits() -> Column:
    """Three edits that a row's id and text determine: an insertion, a deletion and a replacement."""
    h, n = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))), F.length("text") + 1
    at = [F.pmod(F.shiftright(h, k), n).cast("int") for k in (3, 7, 11)]
    cut = [(at[0], at[0], " inserted words, 2 of them"), (at[1], at[1] + 40, ""), (at[2], at[2] + 12, "it's re-placed")]
    return F.array(*(F.struct(F.lit(k).alias("number"), a.alias("start"), b.alias("end"), F.lit(new).alias("new")) for k, (a, b, new) in enumerate(cut)))


def count(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, n_leaves, then after three edits edited_tokens, edited_chars, encoded_chars and made_nodes."""
    trees = stage(build(docs, ranks), "tokencount-trees")
    edited = apply(trees.withColumn("edits", sample_edits()), ranks=ranks)
    return edited.select(
        "doc_id", F.col("tokens_before").alias("n_tokens"), F.col("leaves_before").alias("n_leaves"), n_tokens().alias("edited_tokens"), F.length("text").cast("long").alias("edited_chars"), "encoded_chars", "made_nodes"
    )


def run(docs: DataFrame) -> DataFrame:
    return count(docs)
