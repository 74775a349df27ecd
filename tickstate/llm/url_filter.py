"""URL rules as a trie over reversed host labels and path segments.

A rule names a host and a path prefix; it fits that host and all its subdomains
when the url's path starts with the rule's path. The longest fitting rule (in
characters of host and path) wins; of equal ones a block entry wins.

Defined results: a null url or one without ``://`` has empty host and path and
gets the default verdict; repeated rows are judged each; an empty table gives
an empty result. Scheme, port and user part are not interpreted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULE_BYTES = 64_000_000
_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@dataclass
class _Segment:
    """A path node: complete segments below it, and rules that end inside a segment."""

    below: dict[str, _Segment] = field(default_factory=dict)
    ends: dict[str, tuple[int, bool, str]] = field(default_factory=dict)


@dataclass
class _Label:
    """A host node, reached by labels from the top-level domain down."""

    below: dict[str, _Label] = field(default_factory=dict)
    paths: _Segment | None = None


class UrlTrie:
    """Longest match over ``(verdict, rule)`` pairs such as ``("block", "example.com/de/")``."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root = _Label()
        size = 0
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            if verdict not in ("allow", "block") or not host:
                raise ValueError(f"not a rule: {verdict} {rule!r}")
            size += len(rule)
            if size > MOST_RULE_BYTES:
                raise ValueError(f"rules exceed {MOST_RULE_BYTES} characters")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.below.setdefault(label, _Label())
            node.paths = node.paths or _Segment()
            at = node.paths
            *whole, last = (slash + path).split("/")
            for segment in whole:
                at = at.below.setdefault(segment, _Segment())
            entry = (len(rule), verdict == "block", rule)
            at.ends[last] = max(entry, at.ends.get(last, entry))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest fitting rule."""
        best: tuple[int, bool, str] | None = None
        node, segments = self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            at, depth = node.paths, 0
            while at is not None:
                rest = segments[depth] if depth < len(segments) else None
                if rest is not None:
                    for end, entry in at.ends.items():
                        if rest.startswith(end) and (best is None or entry > best):
                            best = entry
                # a complete segment is one that a slash follows
                at = at.below.get(rest) if depth + 1 < len(segments) else None
                depth += 1
        return best and ("block" if best[1] else "allow", best[2])


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]], *, key: str = "page_id", default: str = "allow"
) -> DataFrame:
    """``key, host, path, rule, verdict`` of every row; ``rule`` is null where none fits."""
    shared = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [trie.match(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([h for h, _ in parts], pa.string()),
                 pa.array([p for _, p in parts], pa.string()),
                 pa.array([f and f[1] for f in found], pa.string()),
                 pa.array([f[0] if f else default for f in found], pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), "url").mapInArrow(
        run, f"`{key}` {kind}, host string, path string, rule string, verdict string"
    )
