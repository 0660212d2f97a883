"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule is a host and the beginning of a path. It fits a url whose host is the rule's or one of
its subdomains and whose path begins with the rule's path, character by character. Of all
rules that fit, the longest match decides: most host labels, then the longest path.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import over_batches

MAX_RULES = 1_000_000
MAX_CHARACTERS = 64_000_000  # of all rules; the trie is sent to all tasks, longer lists are refused

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: verdict, host, beginning of the path
Rule = tuple[str, str, str]


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host behind the first ``://``, A-Z lower-cased, and the path up to ``?`` or ``#``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


class Trie:
    """Nodes are numbers; 0 is the root.

    ``labels`` and ``segments`` lead from a node to the next one. ``ends`` holds, by length, the
    beginnings of a last segment that rules ask for below a node, so one lookup for each length
    tells the longest; ``lengths`` are these lengths, longest first.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.labels: list[dict[str, int]] = [{}]
        self.segments: list[dict[str, int]] = [{}]
        self.ends: dict[int, dict[int, dict[str, tuple[str, str]]]] = {}
        size = 0
        for count, (verdict, host, path) in enumerate(rules, 1):
            size += len(host) + len(path)
            if count > MAX_RULES or size > MAX_CHARACTERS:
                raise ValueError(f"more than {MAX_RULES} rules or {MAX_CHARACTERS} characters")
            host = host.translate(_LOWER)
            node = 0
            for label in reversed(host.split(".")):
                node = self._next(self.labels[node], label)
            *whole, last = path.split("/")
            for segment in whole:
                node = self._next(self.segments[node], segment)
            # A rule given twice keeps its first verdict.
            self.ends.setdefault(node, {}).setdefault(len(last), {}).setdefault(last, (host + path, verdict))
        self.lengths = {node: sorted(found, reverse=True) for node, found in self.ends.items()}

    def _next(self, ways: dict[str, int], name: str) -> int:
        found = ways.get(name)
        if found is None:
            found = ways[name] = len(self.labels)
            self.labels.append({})
            self.segments.append({})
        return found

    def _end(self, node: int, segment: str) -> tuple[str, str] | None:
        for length in self.lengths.get(node, ()):
            if length <= len(segment):
                found = self.ends[node][length].get(segment[:length])
                if found:
                    return found
        return None

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """``rule, verdict`` of the longest match."""
        hosts, node = [], 0
        for label in reversed(host.split(".")):
            node = self.labels[node].get(label)
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in reversed(hosts):
            found = None
            for segment in segments:
                found = self._end(node, segment) or found
                node = self.segments[node].get(segment)
                if node is None:
                    break
            if found:
                return found
        return None


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``page_id, url``.

    A null url and one without ``://`` have an empty host and path. Where no rule fits, rule is
    null and the verdict is ``default``. Repeated rows give repeated results; extra columns are
    ignored. The trie is built once and broadcast; its size is bounded by MAX_RULES and
    MAX_CHARACTERS.
    """
    sent = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def make():
        trie = sent.value

        def work(batch: pa.RecordBatch) -> dict:
            hosts, paths, fits, verdicts = [], [], [], []
            for url in batch.column(0).to_pylist():
                host, path = host_and_path(url)
                rule, verdict = trie.longest(host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                fits.append(rule)
                verdicts.append(verdict)
            columns = {"host": hosts, "path": paths, "rule": fits, "verdict": verdicts}
            return {k: pa.array(v, pa.string()) for k, v in columns.items()}

        return work

    schema = "host string, path string, rule string, verdict string"
    return over_batches(pages.select("url", "page_id"), make, schema, ["page_id"])
