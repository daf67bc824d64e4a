"""Generated, minified or vendored source files, and data saved as code.

Method: each file is lexed and re-emitted in a canonical form (one statement a line), and its own layout is held
against that: an extreme expansion marks minified code, canonical lines that nearly all have one of a few shapes mark
generated code, and literals that make up nearly all of the code mark data.  Vendored copies and the headers tools leave
are told by the comments before the first statement, read against the repository's own name, and by the path.

Defined cases
-------------
* Only rows of type File with a source extension (.py .js .jsx .ts .tsx) are judged; configuration and keys never are.
* A null or blank content gives no row.  Repeated rows of an entity_id give one row.  Very long texts are lexed whole.
* A banner that names the repository itself marks its own code.  Empty tables give empty results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.broken_files import latest_repositories, repository_of
from quarryline.llm.source.grammars import extension
from quarryline.llm.source.layout import Layout
from quarryline.session import spread

SOURCE = frozenset(("py", "js", "jsx", "ts", "tsx"))
#: Canonical lines per line, and mean characters of a line, from which code counts as minified.
MINIFIED_EXPANSION, MINIFIED_LINE = 8.0, 300
#: Distinct shapes per canonical line up to which a file counts as uniform, and the lines it needs for that.
UNIFORM_SHAPES, UNIFORM_LINES = 0.3, 6
#: Share of literals from which a file without any function counts as data.
DATA_LITERALS = 0.6

_TOOL = re.compile(
    r"@generated\b|\b(?:auto-?|machine[- ])?generated (?:by|from|with|on|client|file|code|at)\b|\bcode generated\b|\bdo not (?:edit|modify|change|touch)\b|\bcreated automatically\b"
    r"|\b(?:was|is|were) (?:produced|generated|created) (?:by|from)\b|\bedits will be (?:lost|overwritten)\b|автоматически сгенерирован|сгенерирован[оа]? (?:автоматически|из|с помощью)|не (?:править|редактировать|изменять)\b"
    r"|automatisch (?:erzeugt|generiert)|nicht (?:bearbeiten|ändern)|generado automáticamente|no (?:editar|modificar)\b",
    re.I,
)
_FOREIGN = re.compile(
    r"/\*!\s*@?(?P<a>[\w@/.-]+?)[ @]v?\d+\.\d"
    r"|@license\s+(?P<b>[\w@/.-]+)"
    r"|\b(?P<c>[\w@/-]+)[ @]v?\d+\.\d+(?:\.\d+)?\s*(?:--|,|\|)?\s*(?:bundled|copyright|\(c\)|vendored)"
    r"|copyright \(c\)(?: [\d, -]+)?(?: by)?(?: the)? (?P<d>[\w-]+) (?:contributors|authors|team|project|developers)"
    r"|\b(?:copied|taken|vendored|borrowed|imported|adapted)(?: \w+)? from (?:the )?(?P<e>[\w@/-]+)",
    re.I,
)
_VENDOR_DIR = re.compile(r"(?:^|/)(?:(?:_vendor|vendored|third[_-]?party|extern|external|node_modules|bower_components)/(?P<x>[^/]+)|(?:vendor|libs?)/(?P<y>[^/]+)/)", re.I)
_MIGRATION = re.compile(r"^class Migration\(migrations\.Migration\):", re.M)
_BY_HAND = re.compile(r"\bdef |\bRun(?:Python|SQL)\b")
_FUNCTION = re.compile(r"^\s*(?:async )?def |\bfunction\b|=>|^\s*class ", re.M)


def _project(name: str) -> str:
    return name.lower().strip("@./-").replace("_", "-")


def classify(path: str, text: str, repository: str) -> str | None:
    """``minified``, ``generated``, ``vendored`` or ``data``, or None for hand-written code."""
    ext = extension(path)
    if ext not in SOURCE or not text or not text.strip():
        return None
    own = _project(repository)
    layout = Layout(text, ext == "py")
    literal_data = layout.literal >= DATA_LITERALS and not _FUNCTION.search(text)
    if not literal_data and (layout.expansion >= MINIFIED_EXPANSION or layout.line >= MINIFIED_LINE):
        return "minified"
    if literal_data:
        return "data"
    if _TOOL.search(layout.header) or layout.shapes <= UNIFORM_SHAPES and layout.lines >= UNIFORM_LINES:
        return "generated"
    # The framework's migration writer emits one class of declarative operations; code by hand has functions.
    if _MIGRATION.search(text) and not _BY_HAND.search(text):
        return "generated"
    names = {_project(n) for m in _FOREIGN.finditer(layout.header) for n in m.groups() if n}
    if names and own not in names:
        return "vendored"
    m = _VENDOR_DIR.search(path)
    if m and not names:
        name = _project(m.group("x") or m.group("y"))
        if name != own and not name.startswith(own + "-"):
            return "vendored"
    return None


def file_origins(results: DataFrame) -> DataFrame:
    """One row per file of source code: entity_id, repository, origin (null: hand-written)."""
    files = results.where((F.col("entity_type") == "File") & F.lower("file_path").rlike(r"\.(" + "|".join(sorted(SOURCE)) + r")$"))
    rows = files.select("entity_id", "file_path", "content")

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            kinds = [classify(p, t.as_py(), (i or "").split(":", 2)[1] if i and ":" in i else "") for i, p, t in zip(ids, b.column(1).to_pylist(), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string())], ["entity_id", "origin"])

    return spread(rows).mapInArrow(run, "entity_id string, origin string").distinct().withColumn("repository", repository_of())


def not_handwritten(results: DataFrame) -> DataFrame:
    return file_origins(results).where(F.col("origin").isNotNull()).select("entity_id").distinct()


def origin_report(results: DataFrame, repositories: DataFrame) -> DataFrame:
    """Files by origin per repository, with the repository's number of frameworks."""
    known = latest_repositories(repositories).select(F.col("name").alias("repository"), F.size(F.coalesce("frameworks", F.array().cast("array<string>"))).alias("n_frameworks"))
    counts = file_origins(results).groupBy("repository", F.coalesce("origin", F.lit("handwritten")).alias("origin")).agg(F.count("*").alias("files"))
    return counts.join(known, "repository", "left")
