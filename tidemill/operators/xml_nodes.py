"""XML bodies as a table of nodes in document order.

Every element has its place in the order (pre), the place of the last element inside it (post), its parent's place, and depth, so
that inside, child and first are comparisons of numbers. Elements of feeds come with the entries that they are in:
one row for each item or entry around (entry: its place), and one with entry -1 for what stands right below the root or its
first channel. text is all text inside, markup left out, of elements that stand right below an entry, the channel or the root, and
of names of authors; NULL for others.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows, and letters of text, of a batch of nodes; bytes of a batch of bodies (a longer body travels alone).
_ROWS, _LETTERS, _BYTES = 5000, 1 << 20, 4 << 20

_ATTRIBUTES = ["href", "rel", "src", "url", "width", "height", "srcset"]
NODES = f"entry int, pre int, post int, parent int, depth int, tag string, text string, attributes struct<{', '.join(f'{a}: string' for a in _ATTRIBUTES)}>"
_TYPE = pa.schema([("entry", pa.int32()), ("pre", pa.int32()), ("post", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("attributes", pa.struct([(a, pa.string()) for a in _ATTRIBUTES]))])


def local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower()


def nodes_of(root: ElementTree.Element) -> Iterator[tuple]:
    """Rows of NODES, those of an element after those inside it."""
    names: list[str] = []  # of open elements
    open_: list[tuple[ElementTree.Element, int, Iterator]] = []
    entries: list[int] = []  # places of open items and entries
    channel, pre = None, -1

    def enter(e: ElementTree.Element) -> None:
        nonlocal pre, channel
        pre += 1
        names.append(local_name(e.tag))
        if channel is None and len(names) == 2 and names[-1] == "channel":
            channel = pre
        open_.append((e, pre, iter(e)))
        if names[-1] in ("item", "entry"):
            entries.append(pre)

    enter(root)
    while open_:
        e, place, children = open_[-1]
        child = next(children, None)
        if child is not None:
            enter(child)
            continue
        open_.pop()
        name = names.pop()
        if entries and entries[-1] == place:
            entries.pop()
        parent = open_[-1][1] if open_ else -1
        of_feed = parent == 0 or (channel is not None and parent == channel)
        told = (bool(entries) and parent == entries[-1]) or of_feed or (name == "name" and names and names[-1] == "author")
        around = [*entries, *([-1] if of_feed or place == 0 else []), *([place] if name in ("item", "entry") else [])]
        if around:
            text = "".join(e.itertext()) if told and name not in ("item", "entry", "channel") else None
            given = {a: e.attrib.get(a) for a in _ATTRIBUTES}
            yield from ((a, place, pre, parent, len(names), name, text, given) for a in around)


def node_table(bodies: DataFrame, key: str = "feed_id") -> DataFrame:
    """bodies(key, body) as key, error and NODES; a body that is no XML is one row with an error. A Python worker holds a batch of
    bodies, the tree of one and a batch of nodes."""
    bodies.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BYTES))
    key_type = bodies.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(keys: list, errors: list, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_TYPE)]
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(errors, pa.string()), *columns], [key, "error", *_TYPE.names])

        for batch in batches:
            kind = batch.schema.field(key).type
            for k, body in zip(batch.column(key).to_pylist(), batch.column("body"), strict=True):
                body = body.as_py()
                try:
                    if not body or not body.strip():
                        raise ValueError("empty")
                    root = ElementTree.fromstring(body)
                except (ElementTree.ParseError, ValueError):
                    yield table([k], ["invalid XML"], [(None,) * len(_TYPE)])
                    continue
                rows: list[tuple] = []
                letters = 0
                for row in nodes_of(root):
                    rows.append(row)
                    letters += len(row[6] or "")
                    if len(rows) == _ROWS or letters > _LETTERS:
                        yield table([k] * len(rows), [None] * len(rows), rows)
                        rows, letters = [], 0
                if rows:
                    yield table([k] * len(rows), [None] * len(rows), rows)

    return bodies.select(key, "body").mapInArrow(run, f"{key} {key_type}, error string, {NODES}")
