"""The indexing job: files to entities, entities to a graph, calls to endpoints, nodes to searchable chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.code_text import node_id, normalize_url
from quarryline.operators import extract, graph, lines, retrieval
from quarryline.operators.sized import small_bytes
from quarryline.session import cut_lineage

_API = "array<struct<method:string,url:string,line:int>>"
_FIELD = "array<struct<name:string,type:string,to:string,relation:string>>"
#: What a broadcast row takes beside its text.
_ROW_BYTES = 96
_NODE_KINDS = ("Function", "Method", "Class", "Model", "Component", "Endpoint", "Route", "Serializer")


def _column(name: str, kind: str):
    return F.lit(None).cast(kind).alias(name)


def _endpoint_path():
    return normalize_url(F.concat(F.lit("/"), F.regexp_replace(F.get_json_object("extra", "$.path"), "^/+", "")))


def _repository_of(file_id: str, path: str):
    """Column: what ``node_id`` has between its mark and the path."""
    tail = F.length(F.coalesce(path, F.lit("")))
    return F.substring(file_id, F.lit(6), F.length(file_id) - 5 - F.when(tail > 0, tail + 1).otherwise(0))


def dotted_suffixes(path: str):
    """Column: the module names a Python file can be imported by, from its own name to its whole path."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))


class GraphBuild:
    """Nodes and edges of repositories: files (repository, file_path, content).

    Names are resolved by equality joins with priorities (same file, then repository, then anywhere), the first by
    (path, line); edges keep only existing ends and are distinct.  Contents are read in one pass, which also gives each
    file's row; entities are written once, and nodes are a view of them.
    """

    def __init__(self, files: DataFrame):
        files = files.where(F.col("content").isNotNull()).withColumn("file_id", node_id(F.col("repository"), F.col("file_path")))
        e = extract.extract_entities(files, "file_id", file_rows=True)
        e = e.withColumnRenamed("key", "file_id").withColumn("repository", _repository_of("file_id", "file_path"))
        full = F.when(F.col("parent").isNotNull() & (F.col("entity_kind") == "Method"), F.concat_ws(".", "parent", "name")).otherwise(F.col("name"))
        is_file = F.col("entity_kind") == "File"
        seq = F.when(is_file, F.col("file_path")).otherwise(F.concat_ws("|", "file_path", F.lpad(F.coalesce("start_line", F.lit(0)).cast("string"), 9, "0")))
        found = cut_lineage(e.withColumn("id", F.when(is_file, F.col("file_id")).otherwise(F.concat_ws(":", "file_id", full))).withColumn("seq", seq))
        # A view's own row has no path yet: it keeps apart from the class or function of its name.
        pathless = (F.col("entity_kind") == "Endpoint") & F.get_json_object("extra", "$.path").isNull()
        others = found.where((F.col("entity_kind") != "Endpoint") | pathless).withColumn("id", F.when(pathless, F.concat("id", F.lit(":endpoint"))).otherwise(F.col("id")))
        self.files = files
        self.heads = found.where(is_file)
        self._all = others.unionByName(cut_lineage(self._wired(found, pathless)))
        self.entities = self._all.where("entity_kind <> 'File'")
        self._calls = cut_lineage(self._api_calls())
        self.nodes = self._nodes()
        self.edges = cut_lineage(self._edges())

    def _wired(self, found: DataFrame, pathless) -> DataFrame:
        """Endpoints with a path: the prefixes of the files that include theirs put before it, and their view's method.

        A view with exactly one method gives it to its routes, any other leaves ANY; of several views of one name in a
        repository the last counts.  A module is the file whose path ends with it.
        """
        paths = self.heads.where(F.col("file_path").endswith(".py")).select(F.col("file_id").alias("child"), "repository", F.col("file_path").alias("_path"), F.explode(dotted_suffixes("file_path")).alias("module"))
        includes = found.where("entity_kind = 'Include'").select(F.col("file_id").alias("parent"), "repository", F.col("name").alias("prefix"), F.get_json_object("extra", "$.module").alias("module"))
        known = includes.join(paths, ["repository", "module"]).groupBy("parent", "repository", "prefix", "module").agg(F.min_by("child", F.struct(F.length("_path"), "_path")).alias("child"))
        prefixes = graph.include_prefixes(cut_lineage(known.where("child <> parent").select("child", "parent", "prefix").distinct()))
        views = found.where(pathless).select("repository", F.col("parent").alias("_view"), F.from_json(F.get_json_object("extra", "$.methods"), "array<string>").alias("_methods"), "seq")
        views = views.groupBy("repository", "_view").agg(F.max_by("_methods", "seq").alias("_methods"))
        routes = found.where((F.col("entity_kind") == "Endpoint") & ~pathless)
        view = F.regexp_replace(F.coalesce(F.get_json_object("extra", "$.view"), F.lit("")), r"\.as_view$", "")
        routes = routes.withColumn("_view", F.element_at(F.split(view, r"\."), -1)).withColumn("_own", F.upper(F.coalesce(F.get_json_object("extra", "$.method"), F.lit("ANY"))))
        routes = routes.join(views, ["repository", "_view"], "left").join(prefixes.select(F.col("child").alias("file_id"), F.col("prefix").alias("_prefix")), "file_id", "left")
        one = F.when((F.col("_own") == "ANY") & (F.size("_methods") == 1), F.col("_methods")[0]).otherwise(F.col("_own"))
        path = F.concat(F.lit("/"), F.regexp_replace(F.concat(F.coalesce("_prefix", F.lit("")), F.get_json_object("extra", "$.path")), "^[/^]+", ""))
        routes = routes.withColumn("_method", one).withColumn("_path", path)
        get = lambda k: F.get_json_object("extra", f"$.{k}").alias(k)
        extra = F.to_json(F.struct(F.col("_method").alias("method"), F.col("_path").alias("path"), get("view"), get("framework"), get("request_model"), get("response_model"), get("depends")))
        named = routes.withColumn("extra", extra).withColumn("name", F.concat_ws(" ", "_method", "_path")).withColumn("id", F.concat_ws(":", "file_id", "name"))
        return named.select(found.columns)

    def _kind(self, *kinds: str) -> DataFrame:
        return self.entities.where(F.col("entity_kind").isin(*kinds))

    def _nodes(self) -> DataFrame:
        empty = lambda *names: [_column(c, "string") for c in names]
        repos = self.heads.select("repository").distinct().select(node_id(F.col("repository")).alias("id"), F.lit("Repository").alias("type"), F.col("repository").alias("name"), "repository", *empty("file_path"), _column("start_line", "int"), _column("end_line", "int"), *empty("signature", "docstring", "extra"), F.lit("").alias("seq"))
        kind = F.col("entity_kind")
        name = F.when(kind == "File", F.element_at(F.split("file_path", "/"), -1)).otherwise(F.col("name"))
        ents = self._all.where(kind.isin("File", *_NODE_KINDS)).select("id", F.when(kind == "Serializer", "Class").otherwise(kind).alias("type"), name.alias("name"), "repository", "file_path", "start_line", "end_line", "signature", "docstring", "extra", "seq")
        calls = self._calls.select("id", F.lit("ApiCall").alias("type"), F.concat_ws(" ", "method", "raw_url").alias("name"), "repository", "file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), *empty("signature", "docstring"), F.to_json(F.struct("method", "url")).alias("extra"), F.col("id").alias("seq"))
        rows = reduce(DataFrame.unionByName, [repos, ents, calls])
        # Only rows of an id that occurs again are moved; the last orders make the choice the same for any partitioning.
        repeated = small_bytes(cut_lineage(rows.groupBy("id").count().where("count > 1").select("id")), F.octet_length("id") + _ROW_BYTES)
        once = rows.join(repeated, "id", "left_anti")
        more = retrieval.first_seen(rows.join(repeated, "id", "left_semi"), ["id"], ["seq", "start_line", "type", "name", "end_line", "signature", "docstring", "extra"])
        return once.unionByName(more)

    def api_calls(self) -> DataFrame:
        return self._calls

    def _api_calls(self) -> DataFrame:
        c = self._kind("Component").select("id", "repository", "file_path", F.from_json(F.get_json_object("extra", "$.api_calls"), _API).alias("_c"))
        rows = c.select(F.col("id").alias("component"), "repository", "file_path", F.posexplode("_c").alias("_i", "_x"))
        rows = rows.select("component", "repository", "file_path", F.concat(F.col("component"), F.lit("#call"), F.col("_i").cast("string")).alias("id"), F.upper("_x.method").alias("method"), F.col("_x.url").alias("raw_url"), normalize_url(F.translate("_x.url", "`", "")).alias("url"), F.col("_x.line").alias("line"))
        return rows.where("url <> ''")

    def endpoints(self) -> DataFrame:
        e = self._kind("Endpoint")
        return e.select("id", "repository", "file_id", "parent", F.coalesce(F.get_json_object("extra", "$.method"), F.lit("ANY")).alias("method"), _endpoint_path().alias("path"), F.get_json_object("extra", "$.view").alias("view")).where("path is not null and path <> ''")

    def _references(self) -> DataFrame:
        """(type, role, ref, src, file_id, repository): what each entity names, and the role the named one has."""
        kind, extra = F.col("entity_kind"), lambda k: F.get_json_object("extra", f"$.{k}")
        of = lambda type, role, names: F.transform(names, lambda x: F.struct((F.lit(type) if isinstance(type, str) else type(x)).alias("type"), F.lit(role).alias("role"), (x if isinstance(type, str) else x["to"]).alias("ref")))
        last = lambda c: F.element_at(F.split(c, r"\."), -1)
        words = F.array_distinct(F.concat(F.flatten(F.transform("calls", lambda c: F.split(c, r"\."))), F.flatten(F.transform("params", lambda p: F.split(p, r"[^\w]+"))), F.split(F.coalesce("returns", F.lit("")), r"[^\w]+")))
        bases = of("INHERITS", "class", F.col("bases"))
        fields = of(lambda x: x["relation"], "class", F.filter(F.from_json(extra("fields"), _FIELD), lambda x: x["relation"].isNotNull()))
        view = last(F.regexp_replace(F.coalesce(extra("view"), "parent"), r"\.as_view$", ""))
        # A module is named whole or as the place of the name that is imported.
        module = F.regexp_replace("name", r"^\.+", "")
        modules = F.array(module, F.regexp_replace(module, r"\.[^.]+$", ""))
        named = (
            F.when(kind.isin("Function", "Method"), F.concat(of("CALLS", "function", F.array_distinct(F.transform("calls", last))), of("USES_MODEL", "model", words)))
            .when(kind == "Model", F.concat(bases, F.coalesce(fields, F.array())))
            .when(kind.isin("Class", "Serializer"), bases)
            .when(kind == "Import", of("IMPORTS", "module", modules))
            .when((kind == "Endpoint") & (_endpoint_path() != ""), of("HANDLES_REQUEST", "view", F.array(view)))
            .when(kind == "Route", of("RENDERS_AT", "component", F.array("parent")))
        )
        src = F.when(kind == "Import", F.col("file_id")).otherwise(F.col("id"))
        return self._all.select(src.alias("src"), "file_id", "repository", F.explode(named).alias("_n")).select("_n.*", "src", "file_id", "repository").where("ref <> ''")

    def _targets(self) -> DataFrame:
        """(role, ref, id, file_id, repository, seq): each entity under the names and roles it can be referred to by."""
        kind = F.col("entity_kind")
        of = lambda *roles: F.array(*(F.struct(F.lit(r).alias("role"), F.col("name").alias("ref")) for r in roles))
        modules = F.transform(dotted_suffixes("file_path"), lambda m: F.struct(F.lit("module").alias("role"), m.alias("ref")))
        roles = (
            F.when((kind == "File") & F.col("file_path").endswith(".py"), modules)
            .when(kind.isin("Function", "Method"), of("function", "view"))
            .when(kind == "Model", of("class", "view", "model"))
            .when(kind.isin("Class", "Serializer"), of("class", "view"))
            .when(kind == "Component", of("component"))
        )
        return self._all.select(F.explode(roles).alias("_n"), "id", "file_id", "repository", "seq").select("_n.*", "id", "file_id", "repository", "seq")

    def _resolved(self) -> DataFrame:
        """(src, dst, type) of all references, each to its first target in the file, else the repository, else anywhere.

        Modules are looked for in the repository alone.  Each level is one row a name, so no join makes pairs.
        """
        keys, targets = ["role", "ref"], self._targets()
        names = small_bytes(cut_lineage(targets.select(*keys).distinct()), F.octet_length("ref") + _ROW_BYTES)
        refs = cut_lineage(self._references().join(names, keys, "left_semi"))
        first = lambda rows, on, least: rows.groupBy(*on).agg(F.min(least).alias("_t"))
        level = lambda rows, on, name: rows.select(*on, F.col("_t.id").alias(name))
        live = targets.join(small_bytes(cut_lineage(refs.select(*keys).distinct()), F.octet_length("ref") + _ROW_BYTES), keys, "left_semi")
        in_file = first(live, [*keys, "repository", "file_id"], F.struct("seq", "id"))
        in_repository = first(in_file, [*keys, "repository"], "_t")
        anywhere = first(in_repository, keys, "_t")
        hit = refs.join(level(in_file, [*keys, "repository", "file_id"], "_f"), [*keys, "repository", "file_id"], "left")
        hit = hit.join(level(in_repository, [*keys, "repository"], "_r"), [*keys, "repository"], "left").join(level(anywhere, keys, "_a"), keys, "left")
        target = F.when(F.col("role") == "module", F.col("_r")).otherwise(F.coalesce("_f", "_r", "_a"))
        ends = hit.select("type", "src", target.alias("dst")).where("dst is not null and (type <> 'IMPORTS' or src <> dst)")
        back = F.col("type") == "RENDERS_AT"
        return ends.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"), "type")

    def _edges(self) -> DataFrame:
        """All edges; an end is an entity's own id, but for the class of a method, which is looked up."""
        kind = F.col("entity_kind")
        owner = F.when(kind == "File", node_id(F.col("repository"))).otherwise(F.col("file_id"))
        held = self._all.where(kind.isin("File", *_NODE_KINDS)).select(owner.alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))
        methods = self._kind("Method").select(F.concat_ws(":", "file_id", "parent").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))
        methods = methods.join(self.nodes.select(F.col("id").alias("src")), "src", "left_semi")
        made = self._calls.select(F.col("component").alias("src"), F.col("id").alias("dst"), F.lit("MAKES_CALL").alias("type"))
        self.links = cut_lineage(graph.link_calls(self._calls.select("id", "method", "url"), self.endpoints().select("id", "method", "path")))
        linked = self.links.select("src", "dst", F.lit("CALLS_ENDPOINT").alias("type"))
        return reduce(DataFrame.unionByName, [held, methods, self._resolved(), made, linked]).dropDuplicates(["src", "type", "dst"])

    def chunks(self, dimension: int = 64) -> DataFrame:
        """Searchable chunks of all nodes but files and repositories, with embeddings."""
        n = self.nodes.where(~F.col("type").isin("File", "Repository"))
        code = n.join(self.files.select(F.col("repository"), F.col("file_path"), "content"), ["repository", "file_path"], "left")
        code = code.withColumn("code", lines.slice_lines(F.col("content"), F.coalesce("start_line", F.lit(1)), F.coalesce("end_line", F.lit(0))))
        part = lambda head, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(head), c))
        text = F.concat_ws("\n", part("Name: ", F.col("name")), part("Type: ", F.col("type")), part("File: ", F.col("file_path")), part("Signature: ", F.col("signature")), part("Documentation: ", F.col("docstring")), part("Code: ", F.col("code")))
        pieces = cut_lineage(lines.sub_chunks(code.select("id", text.alias("content")), "id", "content"))
        return pieces.join(retrieval.hash_embeddings(pieces, "chunk_id", "chunk", dimension), "chunk_id")

    def code_of(self, most: int = 0) -> DataFrame:
        """(id, code): the lines of each node in its file, cut to ``most`` characters where that isn't 0."""
        n = self.nodes.where("start_line is not null").select("id", "repository", "file_path", "start_line", "end_line")
        code = lines.slice_lines(F.col("content"), F.col("start_line"), F.coalesce("end_line", F.lit(0)))
        return n.join(self.files.select("repository", "file_path", "content"), ["repository", "file_path"]).select("id", (F.substring(code, 1, most) if most else code).alias("code"))

    def stats(self) -> DataFrame:
        n = self.nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
        return n.unionByName(self.edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))

    def write(self, folder: str, mode: str = "full") -> None:
        """Writes an index: ``full`` nodes, edges and chunks; ``graph`` nodes and edges; ``links`` the API links alone.

        Tables of the mode replace existing ones, the others stay.
        """
        if mode not in ("full", "graph", "links"):
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "links":
            self.links.write.mode("overwrite").parquet(f"{folder}/links")
            return
        self.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/nodes")
        self.edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
        if mode == "full":
            self.chunks().write.mode("overwrite").parquet(f"{folder}/chunks")


def clear_index(spark, folder: str, *tables: str) -> None:
    """Empties the named tables of an index (all of them if none is named); their schemas stay."""
    for name in tables or ("nodes", "edges", "chunks", "links"):
        path = f"{folder}/{name}"
        jvm = spark.sparkContext._jvm
        if jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path)):
            rows = spark.read.parquet(path)
            spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(path)
