"""Nested JSON records as flat linked tables, by vectorised structural indexing.

The entries of an Arrow batch are laid out in one byte buffer. Over the whole buffer bitmaps of quotes, brackets and
delimiters are built: escaped quotes fall out by the parity of the backslashes before them, the parity of quotes tells
what is inside strings, and prefix sums of brackets give the nesting depth. The container of each delimiter is found by a
sorted search among the brackets of its depth, positions in arrays are counts of commas, and names are the spans between
the two quotes before a colon. What stands between neighbouring delimiters is checked against the grammar, all at once.
Rows are then emitted from spans alone: paths grow level by level, each level as one array of strings; no object tree is
built and nothing is done node by node.

A node is an element of a field named ``forms`` or ``senses`` at any depth; each row carries its path and that of the node
it hangs on ('' for the entry itself).

Defined results: null, empty and blank entries, and entries that are no well-formed JSON object or array, have no nodes and
are not ``ok`` in the table of entries; null elements are counted but give no node or tag; a lone object or string counts
as element 0; a bare string has no tags; tags that are neither strings nor null come out as their JSON text; a field given
twice in one object counts twice; half a surrogate pair becomes U+FFFD; repeated entries each give rows; entries of any
length and depth are read whole; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logothek.session import spread

NODES = ("forms", "senses")
NODE_SCHEMA = "entry_id long, node_path string, parent_path string, field string, position int, text string, tag_nos array<int>, tags array<string>"
OPEN = np.zeros(256, bool)
CLOSE = np.zeros(256, bool)
OPEN[[ord("{"), ord("[")]] = True
CLOSE[[ord("}"), ord("]")]] = True


#: Bytes of the entries that are indexed at once; a longer entry is indexed alone.
SLICE = 1 << 21
SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
STRING = r"^(?s:[^\\]|\\(?:[\"\\/bfnrt]|u[0-9A-Fa-f]{4}))*$"


def _allowed() -> np.ndarray:
    """Whether a delimiter, what follows it and the next delimiter go together.

    The first index is 0 to 2 for the start of an object, its colons and commas, 3 and 4 for the start of an array and its
    commas, 5 for a closing bracket; the second 0 for nothing, 1 for a string, 2 for another scalar; the third 0 for an
    opening bracket, 1 for a colon, 2 for a comma, 3 for a closing bracket.
    """
    ok = np.zeros((6, 3, 4), bool)
    ok[0, 1, 1] = ok[0, 0, 3] = True
    ok[2, 1, 1] = True
    for value in (1, 3, 4):
        ok[value, 0, 0] = True
        ok[value, 1:, 2:] = True
    ok[3, 0, 3] = True
    ok[5, 0, 2:] = True
    return ok


ALLOWED = _allowed()


class Index:
    """The structural index of a batch of JSON texts."""

    def __init__(self, texts: list[bytes | None]) -> None:
        parts = [t or b"" for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        buf = self.buf = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.ends = self.starts + lengths
        n_docs = len(parts)

        back = buf == 92
        quote = buf == 34
        if back.any():
            edge = np.diff(np.concatenate(([0], back.astype(np.int8), [0])))
            first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            escaped = past[(past - first) % 2 == 1]
            quote[escaped[escaped < len(buf)]] = False
        self.has_back = np.concatenate(([0], np.cumsum(back)))
        quotes = np.flatnonzero(quote)
        bad = (np.searchsorted(quotes, self.ends) - np.searchsorted(quotes, self.starts)) % 2 == 1
        for i in np.flatnonzero(bad):  # what is inside strings is then known by parity alone
            quote[self.starts[i] : self.ends[i]] = False
        self.quotes = quotes = np.flatnonzero(quote)
        inside = np.cumsum(quote, dtype=np.int32) & 1 == 1

        structural = (OPEN[buf] | CLOSE[buf] | (buf == 44) | (buf == 58)) & ~inside
        tok = np.flatnonzero(structural)
        docs = np.searchsorted(self.starts, tok, "right") - 1
        kind = buf[tok]
        first_tok, last_tok = np.searchsorted(tok, self.starts), np.searchsorted(tok, self.ends)
        padded = np.concatenate(([0], np.cumsum(OPEN[kind].astype(np.int32) - CLOSE[kind].astype(np.int32))))
        rel = padded[1:] - padded[first_tok][docs]  # depth after the token
        bad[docs[rel < 0]] = True
        bad |= (padded[last_tok] != padded[first_tok]) | (last_tok == first_tok)
        keep = ~bad[docs]
        tok, docs, kind, rel = (x[keep] for x in (tok, docs, kind, rel))
        bad |= self._malformed(tok, docs, kind, rel, structural, inside, quote, n_docs)
        keep = ~bad[docs]
        tok, docs, kind, rel = (x[keep] for x in (tok, docs, kind, rel))
        self.ok, self.tok = ~bad, tok
        opens = OPEN[kind]

        # values: what follows an opening square bracket, a comma in an array, or a colon
        holder = self._holders(kind, rel)
        in_array = np.zeros(len(tok), bool)
        held = holder >= 0
        in_array[held] = kind[holder[held]] == 91
        value_tok = np.flatnonzero((kind == 91) | ((kind == 44) & in_array) | (kind == 58))
        solid = np.flatnonzero(buf > 32)
        value_at = solid[np.minimum(np.searchsorted(solid, tok[value_tok] + 1), len(solid) - 1)] if len(solid) else tok[value_tok]
        real = ~((kind[value_tok] == 91) & (buf[value_at] == 93))  # an empty array has no value
        self.value_tok, self.at = value_tok[real], value_at[real]
        self.kind = buf[self.at]
        after = kind[self.value_tok]
        # the bracket a value stands in, its place there (element number or -1 for a named field), its depth and its text
        box = np.where(after == 91, self.value_tok, holder[self.value_tok])
        self.depth = rel[self.value_tok]
        self.doc = docs[self.value_tok]
        self.place = np.full(len(after), -1, np.int64)
        self.place[after == 91] = 0
        commas = np.flatnonzero(after == 44)
        if len(commas):
            order = commas[np.argsort(box[commas], kind="stable")]
            group = box[order]
            new = np.concatenate(([True], group[1:] != group[:-1]))
            run = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            self.place[order] = run + 1
        # names of fields: the span between the two quotes before the colon
        named = np.flatnonzero(after == 58)
        close = np.searchsorted(quotes, tok[self.value_tok[named]]) - 1
        self.name_a = np.full(len(after), -1, np.int64)
        self.name_b = np.full(len(after), -1, np.int64)
        if len(named):
            self.name_a[named] = quotes[close - 1] + 1
            self.name_b[named] = quotes[close]
        # the value that each value stands in (-1: the entry itself)
        value_of_open = np.full(len(tok), -1, np.int64)
        boxes = np.flatnonzero(OPEN[self.kind])
        opened = np.searchsorted(tok, self.at[boxes])
        value_of_open[opened] = boxes
        self.parent = value_of_open[box] if len(box) else box
        # where the text of each value begins and ends
        self.a, self.b = self.at.copy(), tok[np.minimum(self.value_tok + 1, len(tok) - 1)] if len(tok) else self.at.copy()
        strings = np.flatnonzero(self.kind == 34)
        self.a[strings] += 1
        self.b[strings] = quotes[np.searchsorted(quotes, self.at[strings]) + 1] if len(strings) else 0
        if len(boxes):
            self.b[boxes] = tok[self._close_of(rel, opens)[opened]] + 1

    @staticmethod
    def _by_depth(kind: np.ndarray, rel: np.ndarray) -> np.ndarray:
        """Brackets in order of the depth inside them: an opening one is followed by the one that closes it."""
        brackets = np.flatnonzero(OPEN[kind] | CLOSE[kind])
        within = rel[brackets] + CLOSE[kind[brackets]]
        return brackets[np.argsort(within, kind="stable")]

    def _close_of(self, rel: np.ndarray, opens: np.ndarray) -> np.ndarray:
        pairs = self._by_depth(self.buf[self.tok], rel).reshape(-1, 2)
        close = np.full(len(opens), -1, np.int64)
        close[pairs[:, 0]] = pairs[:, 1]
        return close

    @staticmethod
    def _holders(kind: np.ndarray, rel: np.ndarray) -> np.ndarray:
        """The open bracket that holds each open bracket, comma and colon (-1: none)."""
        holder = np.full(len(kind), -1, np.int64)
        opens = OPEN[kind]
        level = np.where(opens, rel - 1, rel)  # depth in which the token stands
        at_open = np.flatnonzero(opens)
        by_depth = at_open[np.argsort(rel[at_open], kind="stable")]
        cuts = np.searchsorted(rel[by_depth], np.arange(1, (rel.max() if len(rel) else 0) + 2))
        look = np.flatnonzero(~CLOSE[kind])
        look = look[np.argsort(level[look], kind="stable")]
        look_cuts = np.searchsorted(level[look], np.arange(0, (level.max() if len(look) else 0) + 2))
        for d in range(1, len(look_cuts) - 1):  # level d is inside brackets after which the depth is d
            here = look[look_cuts[d] : look_cuts[d + 1]]
            holders = by_depth[cuts[d - 1] : cuts[d]]
            holder[here] = holders[np.searchsorted(holders, here) - 1]
        return holder

    def _malformed(self, tok: np.ndarray, docs: np.ndarray, kind: np.ndarray, rel: np.ndarray, structural: np.ndarray, inside: np.ndarray, quote: np.ndarray, n_docs: int) -> np.ndarray:
        """Texts of balanced brackets that are no JSON all the same."""
        bad = np.zeros(n_docs, bool)
        if not len(tok):
            return bad
        buf, quotes = self.buf, self.quotes
        pairs = self._by_depth(kind, rel).reshape(-1, 2)
        bad[docs[pairs[kind[pairs[:, 1]] - kind[pairs[:, 0]] != 2, 0]]] = True
        # scalars: runs of other solid bytes outside strings
        scalar = (buf > 32) & ~inside & ~quote & ~structural
        edge = np.diff(np.concatenate(([0], scalar.astype(np.int8), [0])))
        begin, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc_of = lambda pos: np.searchsorted(self.starts, pos, "right") - 1
        wrong = ~pc.match_substring_regex(self.spans(begin, past), SCALAR).to_numpy(zero_copy_only=False)
        bad[doc_of(begin[wrong])] = True
        # strings: known escapes, no control characters
        opening, closing = quotes[0::2], quotes[1::2]
        odd = np.flatnonzero(self.has_back[closing] > self.has_back[opening])
        wrong = ~pc.match_substring_regex(self.spans(opening[odd] + 1, closing[odd]), STRING).to_numpy(zero_copy_only=False)
        bad[doc_of(opening[odd[wrong]])] = True
        bad[doc_of(np.flatnonzero((buf < 32) & inside))] = True
        space = (buf == 32) | (buf == 10) | (buf == 9) | (buf == 13)
        bad[doc_of(np.flatnonzero((buf <= 32) & ~space))] = True
        # what stands between neighbours, with the ends of a text as neighbours of the first and last delimiter
        first = np.concatenate(([True], docs[1:] != docs[:-1]))
        last = np.concatenate((first[1:], [True]))
        n_quotes = lambda a, b: np.searchsorted(quotes, b) - np.searchsorted(quotes, a)
        n_scalars = lambda a, b: np.searchsorted(begin, b) - np.searchsorted(begin, a)
        lead, tail = tok[first], tok[last]
        bad[docs[first][(n_quotes(self.starts[docs[first]], lead) + n_scalars(self.starts[docs[first]], lead) > 0) | ~OPEN[kind[first]]]] = True
        bad[docs[last][n_quotes(tail, self.ends[docs[last]]) + n_scalars(tail + 1, self.ends[docs[last]]) > 0]] = True
        bad[docs[(rel == 0) & ~last]] = True
        holder = self._holders(kind, rel)
        in_array = np.where(holder >= 0, kind[holder] == 91, False)
        before = np.select([kind == 123, kind == 58, (kind == 44) & ~in_array, kind == 91, kind == 44], [0, 1, 2, 3, 4], 5)
        here = np.flatnonzero(~last)
        nq, ns = n_quotes(tok[here], tok[here + 1]), n_scalars(tok[here], tok[here + 1])
        content = np.where(nq == 2, 1, np.where(ns == 1, 2, 0))
        nxt = kind[here + 1]
        following = np.select([OPEN[nxt], nxt == 58, nxt == 44], [0, 1, 2], 3)
        bad[docs[here[~ALLOWED[before[here], content, following] | (nq // 2 + ns > 1)]]] = True
        return bad

    def spans(self, a: np.ndarray, b: np.ndarray) -> pa.StringArray:
        """The bytes from a to b as strings."""
        offsets = np.concatenate(([0], np.cumsum(b - a)))
        take = np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(a), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.buf[take]))

    def decoded(self, a: np.ndarray, b: np.ndarray, quoted: np.ndarray | None = None) -> pa.StringArray:
        """Spans with the escapes of strings resolved; ``quoted`` tells which spans are strings (None: all)."""
        out = self.spans(a, b)
        odd = self.has_back[b] > self.has_back[a] if len(a) else np.zeros(0, bool)
        if quoted is not None:
            odd &= quoted
        if odd.any():
            escaped = json.loads('["' + '","'.join(out.filter(pa.array(odd)).to_pylist()) + '"]')
            whole = [s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for s in escaped]
            out = pc.replace_with_mask(out, pa.array(odd), pa.array(whole, pa.string()))
        return out

    def names(self, v: np.ndarray) -> pa.StringArray:
        return self.decoded(self.name_a[v], self.name_b[v])

    def texts(self, v: np.ndarray) -> pa.StringArray:
        """Texts of values that are strings; the JSON texts of any others."""
        quoted = self.kind[v] == 34
        out = self.decoded(self.a[v], self.b[v], quoted)
        return out if quoted.all() else pc.if_else(pa.array(quoted), out, pc.ascii_trim_whitespace(out))

    def fields(self, name: str) -> np.ndarray:
        """Whether each value is that of a field of this name."""
        a, b = self.name_a, self.name_b
        hit = np.zeros(len(a), bool)
        raw = np.frombuffer(name.encode(), np.uint8)
        cand = np.flatnonzero((a >= 0) & (b - a == len(raw)))
        for i, c in enumerate(raw):
            cand = cand[self.buf[a[cand] + i] == c]
        hit[cand] = True
        odd = np.flatnonzero((a >= 0) & (self.has_back[np.maximum(b, 0)] > self.has_back[np.maximum(a, 0)]))
        if len(odd):
            hit[odd] |= pc.equal(self.names(odd), name).to_numpy(zero_copy_only=False)
        return hit


def _paths(x: Index, nodes: np.ndarray, lone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Paths of the nodes and of all they stand in, level by level, and where the path of each value is (-1: not made)."""
    needed = np.zeros(len(x.kind), bool)
    needed[nodes] = True
    by_depth = np.argsort(x.depth, kind="stable")
    cuts = np.searchsorted(x.depth[by_depth], np.arange(1, (x.depth.max() if len(x.depth) else 0) + 2))
    levels = [by_depth[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for at in reversed(levels):
        up = x.parent[at[needed[at]]]
        needed[up[up >= 0]] = True
    where, parts, done = np.full(len(x.kind), -1, np.int64), [pa.array([], pa.string())], 0
    above: pa.Array = pa.array([""])
    first_above = 0
    for at in levels:
        v = at[needed[at]]
        if not len(v):
            break
        up = x.parent[v]
        base = above.take(pa.array(np.where(up >= 0, where[up] - first_above, 0)))
        element = x.place[v] >= 0
        own = np.flatnonzero(~element)
        tail = pc.binary_join_element_wise("[", pa.array(np.maximum(x.place[v], 0)).cast(pa.string()), "]", "")
        if len(own):
            names = pc.binary_join_element_wise(x.names(v[own]), pc.if_else(pa.array(lone[v[own]]), "[0]", ""), "")
            dotted = pc.if_else(pc.equal(base.take(pa.array(own)), ""), names, pc.binary_join_element_wise(".", names, ""))
            tail = pc.replace_with_mask(tail, pa.array(~element), dotted)
        above, first_above = pc.binary_join_element_wise(base, tail, ""), done
        where[v] = done + np.arange(len(v))
        done += len(v)
        parts.append(above)
    return pa.concat_arrays(parts), where


def node_rows(ids: pa.Array, texts: list[bytes | None]) -> tuple[pa.RecordBatch, np.ndarray]:
    """The nodes of a batch of entries, and which entries are well-formed."""
    x = Index(texts)
    null, n = x.kind == ord("n"), len(x.kind)
    is_forms, is_senses = x.fields(NODES[0]), x.fields(NODES[1])
    field = is_forms | is_senses
    up = np.maximum(x.parent, 0)
    child = (x.place >= 0) & (x.parent >= 0)
    lone = field & (x.kind != 91) & ~null
    node = lone | (child & field[up] & (x.kind[up] == 91) & ~null) if n else lone
    v = np.flatnonzero(node)
    paths, where = _paths(x, v, lone)
    # the innermost node above each value; values come after what they stand in
    nearest = np.full(n, -1, np.int64)
    by_depth = np.argsort(x.depth, kind="stable")
    cuts = np.searchsorted(x.depth[by_depth], np.arange(1, (x.depth.max() if n else 0) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = by_depth[a:b]
        parent = x.parent[at]
        inherited = np.where(parent >= 0, nearest[np.maximum(parent, 0)], -1)
        nearest[at] = np.where(node[at], at, inherited)
    parent_node = np.where(x.parent[v] >= 0, nearest[up[v]], -1)
    rank = np.full(n + 1, -1, np.int64)  # number of the node that a value is
    rank[v] = np.arange(len(v))

    def given(name: str, strings_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Values of a field of nodes, elements of an array or the lone value, with the number of the node."""
        f = x.fields(name)
        of_array = child & f[up] & (x.kind[up] == 91) if n else f
        w = np.flatnonzero((of_array | (f & (x.kind != 91))) & ~null & ((x.kind == 34) | (not strings_only)))
        holder = np.where(of_array[w], x.parent[up[w]], x.parent[w])
        owner = np.where((holder >= 0) & (x.kind[np.maximum(holder, 0)] == 123), rank[holder], -1) if len(w) else holder
        return w[owner >= 0], owner[owner >= 0]

    text = [(w, owner) for w, owner in (given("form", True), given("glosses", True))]
    bare = v[x.kind[v] == 34]
    w = np.concatenate([bare, *(t[0] for t in text)])
    owner = np.concatenate([rank[bare], *(t[1] for t in text)])
    order = np.lexsort((w, owner))
    owners, first = np.unique(owner[order], return_index=True)
    at_text = np.full(len(v), -1, np.int64)
    at_text[owners] = np.arange(len(owners))
    found = x.texts(w[order][first])
    shown = found.take(pa.array(at_text, mask=at_text < 0))
    t, owner = given("tags", False)
    order = np.lexsort((t, owner))
    t, owner = t[order], owner[order]
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(v)))))[: len(v) + 1], pa.int32())
    up_path = paths.take(pa.array(np.where(parent_node >= 0, where[np.maximum(parent_node, 0)], 0), mask=parent_node < 0)) if len(v) else pa.array([], pa.string())
    in_forms = np.where(x.place[v] >= 0, is_forms[up[v]], is_forms[v]) if len(v) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(x.doc[v])), paths.take(pa.array(where[v])), pc.fill_null(up_path, ""), pc.if_else(pa.array(in_forms), *NODES) if len(v) else pa.array([], pa.string()),
            pa.array(np.maximum(x.place[v], 0), pa.int32()), shown, pa.ListArray.from_arrays(offsets, pa.array(np.maximum(x.place[t], 0), pa.int32())), pa.ListArray.from_arrays(offsets, x.texts(t)),
        ],
        ["entry_id", "node_path", "parent_path", "field", "position", "text", "tag_nos", "tags"],
    ), x.ok


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of runs of rows of at most SLICE bytes, or of one longer text."""
    whole = texts.cast(pa.string()).cast(pa.binary())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(sizes):
        done = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
        yield i, whole.slice(i, j - i).to_pylist()
        i = j


def nodes(entries: DataFrame, key: str = "entry_id", text: str = "entry_json") -> DataFrame:
    """One row for each node with its path, parent, place, text (bare string, ``form`` or first gloss) and tags."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in _slices(b.column(1)):
                yield node_rows(b.column(0).slice(i, len(texts)), texts)[0]

    rows = entries.select(F.col(f"`{key}`").cast("long").alias("entry_id"), F.col(f"`{text}`").alias("entry_json")).where(F.length(F.trim("entry_json")) > 0)
    return spread(rows).mapInArrow(emit, NODE_SCHEMA)


def node_tags(found: DataFrame) -> DataFrame:
    """(entry_id, node_path, tag_no, tag): one row for each tag of a node, one with -1 and '' for a node without any."""
    pairs = F.when(F.size("tags") > 0, F.arrays_zip(F.col("tag_nos").alias("tag_no"), F.col("tags").alias("tag"))).otherwise(F.array(F.struct(F.lit(-1).alias("tag_no"), F.lit("").alias("tag"))))
    return found.select("entry_id", "node_path", F.explode(pairs).alias("t")).select("entry_id", "node_path", F.col("t.tag_no").alias("tag_no"), F.col("t.tag").alias("tag"))


def field_table(found: DataFrame, field: str) -> DataFrame:
    """The flat table of forms or of senses: key (entry, path), parent, place among its siblings and text."""
    return found.where(F.col("field") == field).select("entry_id", "node_path", "parent_path", "position", "text")


def entry_table(entries: DataFrame, key: str = "entry_id", text: str = "entry_json", fields: tuple[str, ...] = ("word", "pos", "lang_code")) -> DataFrame:
    """One row for each entry: whether it is a well-formed object or array, and its own fields of these names where they are strings."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in _slices(b.column(1)):
                x = Index(texts)
                columns = []
                for name in fields:
                    v = np.flatnonzero(x.fields(name) & (x.parent < 0) & (x.kind == 34))[::-1]
                    of = np.full(len(texts), -1, np.int64)
                    of[x.doc[v]] = np.arange(len(v))  # the first of several
                    columns.append(x.texts(v).take(pa.array(of, mask=of < 0)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(texts)), pa.array(x.ok), *columns], ["entry_id", "ok", *fields])

    rows = entries.select(F.col(f"`{key}`").cast("long").alias("entry_id"), F.col(f"`{text}`").alias("entry_json"))
    return spread(rows).mapInArrow(emit, ", ".join(["entry_id long", "ok boolean", *(f"`{f}` string" for f in fields)]))
