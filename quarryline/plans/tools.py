"""Named, parameterised queries over an index, as an answering agent calls them, and the router that picks a kind."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import graph, lines, retrieval


@dataclass
class Index:
    """nodes (id, type, name, file_path, ...), edges (src, dst, type), files (file_path, content)."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame


def _inside(path: str) -> str:
    """A relative path without ways out of its root."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError("path leaves the repository")
    return path.strip("./")


def search_names(ix: Index, name: str, type: str | None = None, limit: int = 30) -> DataFrame:
    rows = ix.nodes.where(F.col("name") == name)
    return (rows if type is None else rows.where(F.col("type") == type)).orderBy("id").limit(limit)


def search_text(ix: Index, part: str, limit: int = 50) -> DataFrame:
    return ix.nodes.where(F.col("name").contains(part) | F.col("id").contains(part)).orderBy("name", "id").limit(limit)


def semantic(ix: Index, query: str, limit: int = 10) -> DataFrame:
    q = ix.files.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    return retrieval.top_k(retrieval.bm25(ix.files, "file_path", "content", q), "file_path", "bm25", limit)


def list_files(ix: Index, directory: str = "", suffix: str = "", limit: int = 100) -> DataFrame:
    root = _inside(directory)
    rows = ix.files.select("file_path").where(F.col("file_path").endswith(suffix))
    return (rows if not root else rows.where(F.col("file_path").startswith(root + "/"))).orderBy("file_path").limit(limit)


def read_file(ix: Index, path: str, start: int = 1, end: int = 0) -> DataFrame:
    return ix.files.where(F.col("file_path") == _inside(path)).select("file_path", lines.slice_lines(F.col("content"), F.lit(start), F.lit(end)).alias("text"))


def grep(ix: Index, token: str, per_file: int = 5, limit: int = 50) -> DataFrame:
    hits = lines.cap_per_file(lines.grep(ix.files, "file_path", "content", [token]), "file_path", per_file)
    return hits.orderBy("file_path", "line_no").limit(limit)


def neighbours(ix: Index, id: str, direction: str = "both", limit: int = 50) -> DataFrame:
    starts = ix.nodes.where(F.col("id") == id)
    return graph.neighbours(ix.edges, ix.nodes, starts, direction=direction).orderBy("type", "id").limit(limit)


def path(ix: Index, start: str, end: str, most: int = 5) -> DataFrame:
    """The length of the shortest undirected path between two nodes, if there is one within ``most`` hops."""
    return graph.shortest_path_lengths(ix.edges, ix.nodes.where(F.col("id") == start), ix.nodes.where(F.col("id") == end), most)


TOOLS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (search_names, search_text, semantic, list_files, read_file, grep, neighbours, path)}


@dataclass
class Exploration:
    calls: list[tuple[str, dict, int]] = field(default_factory=list)
    stopped: str = ""

    def summary(self) -> dict[str, Any]:
        per: dict[str, int] = {}
        for name, _, _ in self.calls:
            per[name] = per.get(name, 0) + 1
        return {"calls": len(self.calls), "rows": sum(n for _, _, n in self.calls), "by_tool": per}


def explore(ix: Index, question: str, plan: Callable[[str, list], list[tuple[str, dict]]], iterations: int = 30, seconds: float = 600.0, each: int = 3, rows: int = 50) -> Exploration:
    """Runs at most ``each`` tool calls a turn, as ``plan`` (a model or a rule) asks, within a budget of turns and time."""
    out, began, seen = Exploration(), time.monotonic(), []
    for _ in range(iterations):
        wanted = plan(question, seen[-5:])[:each]
        if not wanted:
            out.stopped = "done"
            return out
        for name, args in wanted:
            if time.monotonic() - began > seconds:
                out.stopped = "time"
                return out
            found = TOOLS[name](ix, **args).limit(rows).collect()
            out.calls.append((name, args, len(found)))
            seen.append((name, args, found))
    out.stopped = "iterations"
    return out


_READ_ONLY = re.compile(r"^\s*(?:with|select|values|table)\b", re.I)
_FORBIDDEN = re.compile(r"\b(?:insert|update|delete|merge|drop|create|alter|truncate|set|add|cache|refresh|load|call|use|grant)\s", re.I)


def run_read_only(ix: Index, sql: str, limit: int = 50) -> DataFrame:
    """A query over the views ``nodes``, ``edges`` and ``files``; anything that isn't a pure query is refused."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if not _READ_ONLY.match(bare) or _FORBIDDEN.search(bare) or ";" in bare.strip().rstrip(";"):
        raise ValueError("only a single read-only query is allowed")
    for name in ("nodes", "edges", "files"):
        getattr(ix, name).createOrReplaceTempView(name)
    return ix.nodes.sparkSession.sql(sql.strip().rstrip(";")).limit(limit)
