"""Entities of source files: Python by its syntax tree, Django, FastAPI and React conventions on top, and nodes of them."""

from __future__ import annotations

import ast
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.fixed_values import DJANGO_MARKS, FASTAPI_MARKS
from quarryline.operators.react import react_rows

ENTITY = "entity_kind string, name string, parent string, signature string, docstring string, start_line int, end_line int, decorators array<string>, bases array<string>, calls array<string>, params array<string>, returns string, is_async boolean, extra string"
_FIELDS = [x.strip().rsplit(" ", 1)[0] for x in ENTITY.split(", ")]
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
#: Class-based view bases and the methods they serve.
VIEW_BASES = {
    "ListAPIView": ["GET"], "RetrieveAPIView": ["GET"], "CreateAPIView": ["POST"], "DestroyAPIView": ["DELETE"], "UpdateAPIView": ["PUT", "PATCH"], "ListCreateAPIView": ["GET", "POST"],
    "RetrieveUpdateAPIView": ["GET", "PUT", "PATCH"], "RetrieveDestroyAPIView": ["GET", "DELETE"], "RetrieveUpdateDestroyAPIView": ["GET", "PUT", "PATCH", "DELETE"],
    "ModelViewSet": ["GET", "POST", "PUT", "PATCH", "DELETE"], "ReadOnlyModelViewSet": ["GET"],
    "GenericViewSet": ["GET", "POST", "PUT", "PATCH", "DELETE"], "ViewSet": ["GET", "POST", "PUT", "PATCH", "DELETE"],
}
RELATIONS = {"ForeignKey": "FOREIGN_KEY", "ManyToManyField": "MANY_TO_MANY", "OneToOneField": "ONE_TO_ONE"}


def _row(kind: str, name: str | None, **more) -> dict:
    base = dict.fromkeys(_FIELDS)
    base |= {"entity_kind": kind, "name": name, "decorators": [], "bases": [], "calls": [], "params": [], "is_async": False}
    return base | more


def _dotted(node: ast.expr) -> str:
    try:
        return ast.unparse(node)
    except Exception:  # noqa: BLE001
        return ""


def _calls(body: ast.AST) -> list[str]:
    """Distinct callees in order; those of self or cls by their bare name."""
    found: dict[str, None] = {}
    for n in ast.walk(body):
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                found.setdefault(n.func.id)
            elif isinstance(n.func, ast.Attribute):
                text = _dotted(n.func)
                found.setdefault(text.partition(".")[2] if text.startswith(("self.", "cls.")) and text.count(".") == 1 else text)
    return [c for c in found if c]


def _function(f: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None) -> dict:
    a = f.args
    params = [x.arg + (f": {_dotted(x.annotation)}" if x.annotation else "") for x in [*a.posonlyargs, *a.args]]
    params += [f"*{a.vararg.arg}"] if a.vararg else []
    params += [x.arg + (f": {_dotted(x.annotation)}" if x.annotation else "") for x in a.kwonlyargs]
    params += [f"**{a.kwarg.arg}"] if a.kwarg else []
    returns = _dotted(f.returns) if f.returns else None
    is_async = isinstance(f, ast.AsyncFunctionDef)
    head = f"{'async ' if is_async else ''}def {f.name}({_dotted(a)})" + (f" -> {returns}" if returns else "")
    decorators = ["@" + _dotted(d.func if isinstance(d, ast.Call) else d) for d in f.decorator_list]
    return _row("Method" if parent else "Function", f.name, parent=parent, signature=head, docstring=ast.get_docstring(f), start_line=f.lineno, end_line=f.end_lineno, decorators=decorators, calls=_calls(ast.Module(body=f.body, type_ignores=[])), params=params, returns=returns, is_async=is_async)


def _endpoint(f: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[dict]:
    for d in f.decorator_list:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in HTTP_VERBS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
            models = {k.arg: _dotted(k.value) for k in d.keywords if k.arg == "response_model"}
            body = [x for x in f.args.args if x.annotation and _dotted(x.annotation) not in ("str", "int", "float", "bool", "Request")]
            depends = [_dotted(v.args[0]) for v in f.args.defaults if isinstance(v, ast.Call) and _dotted(v.func) == "Depends" and v.args]
            extra = {"method": d.func.attr.upper(), "path": d.args[0].value, "framework": "fastapi", "request_model": _dotted(body[-1].annotation) if body else "", "response_model": models.get("response_model", _dotted(f.returns) if f.returns else ""), "depends": depends}
            yield _row("Endpoint", f"{extra['method']} {extra['path']}", parent=f.name, start_line=f.lineno, end_line=f.end_lineno, extra=json.dumps(extra, sort_keys=True))
        elif isinstance(d, ast.Call) and _dotted(d.func) == "api_view":
            methods = [x.value.upper() for a in d.args if isinstance(a, ast.List | ast.Tuple) for x in a.elts if isinstance(x, ast.Constant)] or ["GET"]
            yield _row("Endpoint", f.name, parent=f.name, start_line=f.lineno, end_line=f.end_lineno, extra=json.dumps({"methods": sorted(set(methods)), "framework": "django"}, sort_keys=True))
        elif _dotted(d) == "api_view":
            yield _row("Endpoint", f.name, parent=f.name, start_line=f.lineno, end_line=f.end_lineno, extra=json.dumps({"methods": ["GET"], "framework": "django"}, sort_keys=True))


def _class(c: ast.ClassDef) -> Iterator[dict]:
    bases = [_dotted(b) for b in c.bases if isinstance(b, ast.Name | ast.Attribute)]
    decorators = ["@" + _dotted(d.func if isinstance(d, ast.Call) else d) for d in c.decorator_list]
    short = [b.rpartition(".")[2] for b in bases]
    extra, kind = {}, "Class"
    fields = []
    for s in c.body:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Call):
            called = _dotted(s.value.func).rpartition(".")[2]
            if called.endswith("Field") or called in RELATIONS:
                to = _dotted(s.value.args[0]).strip("'\"").rpartition(".")[2] if called in RELATIONS and s.value.args else None
                fields.append({"name": s.targets[0].id, "type": called, "to": to, "relation": RELATIONS.get(called)})
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            fields.append({"name": s.target.id, "type": _dotted(s.annotation), "to": None, "relation": None})
    if "Model" in short:
        kind, extra = "Model", {"model_type": "django", "fields": [f for f in fields if f["type"].endswith("Field") or f["relation"]]}
    elif any("BaseModel" in b for b in short):
        kind, extra = "Model", {"model_type": "pydantic", "fields": [f for f in fields if f["relation"] is None]}
    elif any("Serializer" in b for b in short):
        kind, extra = "Serializer", {"fields": fields}
    elif any(b in VIEW_BASES or b.endswith(("APIView", "ViewSet")) for b in short):
        own = {s.name.upper() for s in c.body if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef) and s.name in HTTP_VERBS}
        extra = {"methods": sorted(own | {m for b in short for m in VIEW_BASES.get(b, [])}) or ["ANY"], "framework": "django"}
        yield _row("Endpoint", c.name, parent=c.name, start_line=c.lineno, end_line=c.end_lineno, extra=json.dumps(extra, sort_keys=True))
        extra = {}
    elif "@dataclass" in decorators or "@dataclasses.dataclass" in decorators:
        extra = {"dataclass": True, "fields": fields}
    yield _row(kind, c.name, docstring=ast.get_docstring(c), start_line=c.lineno, end_line=c.end_lineno, decorators=decorators, bases=bases, extra=json.dumps(extra, sort_keys=True) if extra else None)
    for s in c.body:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
            yield _function(s, c.name)


def _urls(tree: ast.Module) -> Iterator[dict]:
    """Routes of urlpatterns and routers."""
    routers = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "register" and len(n.args) >= 2 and isinstance(n.args[0], ast.Constant):
            routers[str(n.args[0].value)] = _dotted(n.args[1])
        elif isinstance(n, ast.Call) and _dotted(n.func).rpartition(".")[2] in ("path", "re_path", "url") and len(n.args) >= 2 and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
            target = n.args[1]
            if isinstance(target, ast.Call) and _dotted(target.func).rpartition(".")[2] == "include":
                inner = target.args[0] if target.args else None
                module = inner.value if isinstance(inner, ast.Constant) else _dotted(inner) if inner is not None else ""
                yield _row("Include", n.args[0].value, start_line=n.lineno, end_line=n.end_lineno, extra=json.dumps({"module": module}))
            else:
                view = _dotted(target.func.value if isinstance(target, ast.Call) and isinstance(target.func, ast.Attribute) and target.func.attr == "as_view" else target)
                yield _row("Endpoint", f"ANY {n.args[0].value}", start_line=n.lineno, end_line=n.end_lineno, extra=json.dumps({"method": "ANY", "path": n.args[0].value, "view": view, "framework": "django"}, sort_keys=True))
    for prefix, view in routers.items():
        for path in (f"{prefix}/", f"{prefix}/{{param}}/"):
            yield _row("Endpoint", f"ANY {path}", start_line=0, end_line=0, extra=json.dumps({"method": "ANY", "path": path, "view": view, "framework": "django"}, sort_keys=True))


def python_entities(path: str, text: str) -> Iterator[dict]:
    """Module functions, classes, their methods, imports, endpoints and routes; a syntax error gives one Error row.

    The interpreter's parser answers a text nested beyond its stack with MemoryError: an Error row as well.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield _row("Error", type(e).__name__, extra=str(e)[:200])
        return
    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            yield _function(n, None)
            yield from _endpoint(n)
        elif isinstance(n, ast.ClassDef):
            yield from _class(n)
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            yield from (_row("Import", a.name, start_line=n.lineno) for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            yield from (_row("Import", "." * n.level + ".".join(x for x in (n.module or "", a.name) if x), start_line=n.lineno) for a in n.names)
    if "urlpatterns" in text or ".register(" in text:
        yield from _urls(tree)


_COMPONENT = re.compile(r"(?:^|\n)[ \t]*(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function\s+([A-Z]\w*)\s*(?:<[^>]*>)?\s*\(([^)]*)|const\s+([A-Z]\w*)\s*(?::\s*[\w.]*(?:FC|FunctionComponent)<?\s*(\w*)>?)?\s*=\s*(?:React\.memo\(|memo\()?\s*(?:async\s*)?(?:\(([^)]*)\)|function\s*\(([^)]*)\)|\w+)\s*(?::\s*[\w.<>\[\], ]+)?\s*(?:=>|\{))")
_HOOK = re.compile(r"\b(use[A-Z]\w*)\s*(?:<[^>]*>)?\(")
_FETCH = re.compile(r"\bfetch\(\s*([`'\"])([^`'\"]+)\1\s*(?:,\s*\{[^}]*?method:\s*['\"](\w+)['\"])?")
_AXIOS = re.compile(r"\b(?:axios|api|http|client|\w*[sS]ervice)\.(get|post|put|patch|delete)\s*(?:<[^>]*>)?\(\s*([`'\"])([^`'\"]+)\2")
_HANDLER = re.compile(r"\bon[A-Z]\w*(?==\{)")
_ROUTE = re.compile(r"<Route\b[^>]*?\bpath=[\"'{]+([^\"'}]+)[\"'}]+[^>]*?(?:element=\{\s*<(\w+)|component=\{(\w+))")


def react_entities(path: str, text: str) -> Iterator[dict]:
    """Imports, components with props, hooks and handlers, API calls and routes, by the syntax tree.

    A file that isn't valid is read by patterns instead.
    """
    rows = react_rows(path, text, _row)
    yield from rows if rows is not None else _react_by_pattern(path, text)


def _react_by_pattern(path: str, text: str) -> Iterator[dict]:
    """Components with props, hooks and handlers, API calls and routes, by pattern; other functions give nothing."""
    starts = [(m.start(1) if m.group(1) else m.start(3), m) for m in _COMPONENT.finditer(text)]
    ends = [s for s, _ in starts[1:]] + [len(text)]
    for (at, m), end in zip(starts, ends):
        body = text[at:end]
        if "<" not in body or not re.search(r"<[A-Za-z>]", body):
            continue
        name = m.group(1) or m.group(3)
        args = next((a for a in (m.group(2), m.group(5), m.group(6)) if a), "")
        props = m.group(4) or (args.rpartition(":")[2].strip() if ":" in args else "")
        line = text.count("\n", 0, at) + 1
        hooks = list(dict.fromkeys(_HOOK.findall(body)))
        handlers = list(dict.fromkeys(_HANDLER.findall(body)))
        calls = [{"method": (x.group(3) or "GET").upper(), "url": x.group(2), "line": line + body.count("\n", 0, x.start())} for x in _FETCH.finditer(body)]
        calls += [{"method": x.group(1).upper(), "url": x.group(3), "line": line + body.count("\n", 0, x.start())} for x in _AXIOS.finditer(body)]
        extra = {"props_type": props, "hooks": hooks, "handlers": handlers, "api_calls": calls, "exported": "export" in m.group()}
        yield _row("Component", name, start_line=line, end_line=line + body.rstrip().count("\n"), calls=[f"{c['method']} {c['url']}" for c in calls], extra=json.dumps(extra, sort_keys=True))
    for m in _ROUTE.finditer(text):
        yield _row("Route", m.group(1), parent=m.group(2) or m.group(3), start_line=text.count("\n", 0, m.start()) + 1, extra=None)


#: Extractors by extension: the registry that further languages are added to.
EXTRACTORS: dict[str, Callable[[str, str], Iterator[dict]]] = {"py": python_entities, "jsx": react_entities, "tsx": react_entities, "js": react_entities, "ts": react_entities}


def register_extractor(extension: str, extractor: Callable[[str, str], Iterator[dict]]) -> None:
    EXTRACTORS[extension] = extractor


def extract_entities(files: DataFrame, key: str = "entity_id", path: str = "file_path", text: str = "content", file_rows: bool = False) -> DataFrame:
    """(key, file_path, entity columns): the entities of each file, in one Arrow pass.

    With ``file_rows`` each file, of any kind, also gives a File row: its lines, and in ``extra`` hash, size and line count.
    """
    extractors = dict(EXTRACTORS)
    rows = files.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(path).alias("file_path"), F.col(text).alias("content"))
    list_type = pa.list_(pa.string())
    types = {"start_line": pa.int32(), "end_line": pa.int32(), "is_async": pa.bool_()} | dict.fromkeys(("decorators", "bases", "calls", "params"), list_type)

    def whole(column):
        for t, size, breaks in zip(column, pc.utf8_length(column).to_pylist(), pc.count_substring(column, "\n").to_pylist()):
            extra = {"content_hash": hashlib.sha256(t.as_buffer()).hexdigest(), "size": size, "line_count": breaks + 1}
            yield _row("File", None, start_line=1, end_line=breaks + 1, extra=json.dumps(extra, separators=(",", ":")))

    def run(batches):
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("key", "file_path", *_FIELDS)}
            heads = whole(b.column(2)) if file_rows else iter(())
            for k, p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                make = extractors.get((p or "").rpartition(".")[2].lower())
                for row in itertools.chain(itertools.islice(heads, 1), make(p, t.as_py()) if make else ()):
                    out["key"].append(k)
                    out["file_path"].append(p)
                    for n in _FIELDS:
                        out[n].append(row[n])
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.string())) for n, v in out.items()], list(out))

    return rows.mapInArrow(run, f"key string, file_path string, {ENTITY}")


def framework_vote(text, chars: int | None = None):
    """Column: django or fastapi by the marks in the text (in its first ``chars``, if given), else python."""
    head = text if chars is None else F.substring(text, 1, chars)
    count = lambda marks: sum((F.when(head.contains(m), 1).otherwise(0) for m in marks), F.lit(0))
    d, f = count(DJANGO_MARKS), count(FASTAPI_MARKS)
    return F.when((d >= 2) & (d > f), "django").when(f >= 2, "fastapi").otherwise("python")
