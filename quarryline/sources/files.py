"""Repositories, documents and metadata as DataFrames."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from fnmatch import translate
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.fixed_values import IGNORED, LANGUAGE_OF, SKIPPED_FRAGMENTS
from quarryline.functions.code_text import document_type
from quarryline.operators import lines
from quarryline.sources.git import ignore_patterns

CODE_EXTENSIONS = ("py", "js", "jsx", "ts", "tsx")


def ignore_regex(patterns: list[str] | tuple[str, ...]) -> str:
    """One regular expression for git-style patterns, for paths with forward slashes."""
    parts = []
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        body = re.sub(r"^\(\?s:(.*)\)(?:\\Z|\\z)$", r"\1", translate(p.strip("/"))).replace(".*", "[^/]*")
        head = "^" if p.startswith("/") or "/" in p.strip("/") else "(?:^|/)"
        parts.append(head + body + ("/" if p.endswith("/") else "(?:/|$)"))
    return "|".join(parts) or r"(?!)"


def ignored(path: Column, extra: list[str] | None = None) -> Column:
    return path.rlike(ignore_regex([*IGNORED, *(extra or [])]))


def code_files(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Files with a code extension, without tests, migrations and skipped folders (substring rules)."""
    p = F.col(path)
    keep = p.rlike(r"\.(" + "|".join(CODE_EXTENSIONS) + ")$") & ~F.lower(F.element_at(F.split(p, "/"), -1)).contains("test") & ~p.contains("migration")
    for x in SKIPPED_FRAGMENTS:
        keep = keep & ~p.contains(x)
    return files.where(keep)


def read_repository(spark: SparkSession, root: str, repository: str, extra_ignored: list[str] | None = None) -> DataFrame:
    """(repository, file_path, size_bytes, content, content_hash, line_count) of the files below a folder.

    Besides the fixed patterns those of the folder's own ``.ragignore`` are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    local = re.sub(r"^file:/*", "/", root)
    extra_ignored = [*(extra_ignored or []), *ignore_patterns(local)]
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    rel = F.substring(path, len(base) + 2, 1 << 20)
    files = raw.select(F.lit(repository).alias("repository"), rel.alias("file_path"), F.col("length").alias("size_bytes"), F.col("content").alias("_b"))
    files = files.where(~ignored(F.col("file_path"), extra_ignored))
    text = F.try_validate_utf8(F.col("_b").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("_b").cast("string")
    return files.select("repository", "file_path", "size_bytes", text.alias("content"), F.sha2("_b", 256).alias("content_hash")).withColumn("line_count", F.size(F.split("content", "\n")))


def project_profile(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """(repository, languages, frameworks, project_type, confidence) by extensions, markers and dependencies."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[ext]
    name = F.element_at(F.split(path, "/"), -1)
    content = F.coalesce(F.col(text), F.lit(""))
    marks = {
        "django": (name == "manage.py") | (name.isin("requirements.txt", "pyproject.toml") & F.lower(content).contains("django")) | content.contains("from django"),
        "fastapi": (name.isin("requirements.txt", "pyproject.toml") & F.lower(content).contains("fastapi")) | content.contains("from fastapi"),
        "react": ((name == "package.json") & content.contains('"react"')) | content.rlike("from ['\"]react['\"]"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in marks.items()]), lambda x: x.isNotNull())
    per = files.select("repository", lang.alias("_lang"), found.alias("_f"))
    agg = per.groupBy("repository").agg(F.array_sort(F.collect_set("_lang")).alias("languages"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_f")))).alias("frameworks"))
    back = F.arrays_overlap("frameworks", F.array(F.lit("django"), F.lit("fastapi")))
    front = F.array_contains("frameworks", "react")
    kind = F.when(back & front, "fullstack").when(back, "backend").when(front, "frontend").when(F.array_contains("languages", "python"), "backend").otherwise("unknown")
    confidence = F.when(back & front, 0.9).when(back | front, 0.9).when(kind == "backend", 0.7).otherwise(0.3)
    return agg.withColumn("project_type", kind).withColumn("confidence", confidence)


#: Core properties of a document and their tags.
_PROPERTIES = {
    "title": "{http://purl.org/dc/elements/1.1/}title",
    "author": "{http://purl.org/dc/elements/1.1/}creator",
    "created": "{http://purl.org/dc/terms/}created",
    "modified": "{http://purl.org/dc/terms/}modified",
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(data: bytes) -> dict:
    """title, full_text and sections (title, level, content, position) of a .docx file, tables as tab-separated lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        images = sum(n.startswith("word/media/") for n in z.namelist())
        hashes = sorted({hashlib.sha256(z.read(n)).hexdigest() for n in z.namelist() if n.startswith("word/media/")})
        core = dict.fromkeys(_PROPERTIES, None)
        if "docProps/core.xml" in z.namelist():
            tree = ElementTree.fromstring(z.read("docProps/core.xml"))
            core = {k: node.text if (node := tree.find(tag)) is not None else None for k, tag in _PROPERTIES.items()}
        title = core["title"] or ""
    lines, sections = [], []
    for block in body if body is not None else []:
        if block.tag == f"{_W}tbl":
            text = "\n".join("\t".join("".join(t.text or "" for t in cell.iter(f"{_W}t")) for cell in row.iter(f"{_W}tc")) for row in block.iter(f"{_W}tr"))
            level = 0
        elif block.tag == f"{_W}p":
            text = "".join(t.text or "" for t in block.iter(f"{_W}t"))
            style = block.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"(?:Heading|heading|Заголовок)\s?(\d)", style.get(f"{_W}val", "") if style is not None else "")
            level = int(m.group(1)) if m else 0
        else:
            continue
        if not text.strip():
            continue
        lines.append(text)
        if level:
            sections.append({"title": text, "level": level, "content": "", "position": len(sections)})
        elif sections:
            sections[-1]["content"] += ("\n" if sections[-1]["content"] else "") + text
    return {"title": title or (sections[0]["title"] if sections else ""), "full_text": "\n".join(lines), "sections": sections, "images": images, "image_hashes": hashes, "author": core["author"], "created_date": core["created"], "modified_date": core["modified"]}


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, full_text, sections, images_count, error) of the .docx files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(root).select("path", "content")
    section = pa.list_(pa.struct([("title", pa.string()), ("level", pa.int32()), ("content", pa.string()), ("position", pa.int32())]))

    def run(batches):
        for b in batches:
            out = []
            for data in b.column(1):
                try:
                    out.append(parse_docx(data.as_py()) | {"error": None})
                except Exception as e:  # noqa: BLE001
                    out.append({"title": None, "full_text": None, "sections": [], "images": 0, "image_hashes": [], "author": None, "created_date": None, "modified_date": None, "error": type(e).__name__})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[k] for x in out], t) for k, t in (("title", pa.string()), ("full_text", pa.string()), ("sections", section), ("images", pa.int32()), ("image_hashes", pa.list_(pa.string())), ("author", pa.string()), ("created_date", pa.string()), ("modified_date", pa.string()), ("error", pa.string())))],
                ["path", "title", "full_text", "sections", "images_count", "image_hashes", "author", "created_date", "modified_date", "error"],
            )

    return raw.mapInArrow(run, "path string, title string, full_text string, sections array<struct<title:string,level:int,content:string,position:int>>, images_count int, image_hashes array<string>, author string, created_date string, modified_date string, error string")


def document_chunks(documents: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(chunk_id, path, title, document_type, author, part, content): the text of readable documents in overlapping parts."""
    readable = documents.where("error is null and full_text is not null and full_text <> ''")
    parts = lines.sub_chunks(readable.select("path", F.col("full_text").alias("_t")), "path", "_t", size, size - 2 * overlap if size > 4 * overlap else size, overlap)
    about = readable.select("path", "title", document_type(F.element_at(F.split("path", "/"), -1)).alias("document_type"), "author", "created_date", "modified_date", F.size("sections").alias("sections_count"), "images_count")
    return parts.join(about, "path").select("chunk_id", "path", "title", "document_type", "author", "created_date", "modified_date", "sections_count", "images_count", "part", F.col("chunk").alias("content"))


def index_documents(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Reads the documents below a folder and writes their chunks, replacing an index that is there; returns the chunks."""
    document_chunks(read_documents(spark, root)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Repository metadata written as JSON by ``write_metadata``."""
    return spark.read.schema("name string, path string, url string, branch string, commit_hash string, last_updated timestamp, project_type string, languages array<string>, frameworks array<string>").json(path)


def write_metadata(repositories: DataFrame, path: str) -> None:
    repositories.write.mode("overwrite").json(path)
