"""Word lists, patterns and tables that results depend on, stated as they have to be."""

from __future__ import annotations


#: Words of a question about the user interface.
FRONTEND_WORDS = (
    "component", "button", "form", "input", "page", "screen", "view", "modal", "dialog", "popup", "menu",
    "navigation", "navbar", "sidebar", "header", "footer", "layout", "template", "react", "jsx", "tsx", "hook",
    "usestate", "useeffect", "usememo", "props", "render", "virtual dom", "css", "style", "styled", "tailwind",
    "bootstrap", "theme", "color", "font", "responsive", "click", "hover", "scroll", "animation", "transition",
    "display", "show", "hide", "toggle", "redux", "zustand", "context", "state management", "route", "router",
    "redirect", "link", "ui", "ux", "interface", "user interface", "frontend",
)

#: Words of a question about the server side.
BACKEND_WORDS = (
    "api", "endpoint", "rest", "graphql", "http", "request", "response", "get", "post", "put", "delete", "patch",
    "database", "db", "query", "model", "table", "schema", "migration", "orm", "sql", "nosql", "postgres", "mysql",
    "mongo", "django", "view", "viewset", "serializer", "queryset", "admin", "middleware", "fastapi", "pydantic",
    "depends", "dependency", "backend", "server", "service", "controller", "repository", "business logic",
    "validation", "authentication", "authorization", "permission", "jwt", "token", "session", "process", "calculate",
    "transform", "aggregate", "filter", "pagination", "cache", "redis",
)

#: Words of a question about both.
HYBRID_WORDS = (
    "как работает", "поток данных", "full flow", "end to end", "complete process", "integration", "connect", "связь",
    "from ui to database", "from frontend to backend", "whole system", "entire flow",
)

#: Words that start a path from the interface to the data.
UI_WORDS = (
    "ui", "view", "frontend", "button", "form", "component", "template", "html", "css", "react", "vue", "angular",
    "page", "screen", "widget", "render", "display", "show",
)

#: Words that end it.
DATA_LINK_WORDS = (
    "database", "model", "data", "api", "backend", "server",
)

#: Words that start a path from the data to the interface.
DATA_WORDS = (
    "database", "model", "table", "schema", "migration", "orm", "django model", "sqlalchemy", "entity", "repository",
    "dao",
)

#: Words that end it.
UI_USE_WORDS = (
    "used", "displayed", "shown", "view", "frontend", "ui",
)

#: Words of a question about documents.
DOCUMENT_WORDS = (
    "документ", "регламент", "правил", "инструкц", "политик", "document", "regulation", "policy", "guideline",
)

#: Words of a question about code.
CODE_WORDS = (
    "код", "функци", "класс", "компонент", "api", "реализ", "code", "function", "class", "component", "implement",
    "how does",
)

#: Words of a question about screens.
VISUAL_WORDS = (
    "покажи", "экран", "кнопк", "форм", "ui", "интерфейс", "show", "screen", "button", "form", "interface", "click",
)

#: Words that are no identifiers of interest.
IDENTIFIER_STOPWORDS = (
    "self", "cls", "true", "false", "none", "null", "undefined",
)

#: Kinds of a diagram and the words that ask for one, in order.
DIAGRAM_WORDS = (
    ("sequence", ("flow", "поток", "trace", "трейс", "journey")),
    ("component", ("architecture", "архитектура", "structure", "структура", "depends")),
    ("er", ("model", "модел", "data", "данн", "schema", "схема")),
    ("flow", ("logic", "логик", "algorithm", "алгоритм", "decision")),
)

#: Kinds of a document by stems of its name, in order.
DOCUMENT_TYPES = (
    ("Instruction", ("инструкц", "instruction")),
    ("SOP", ("соп", "sop")),
    ("Policy", ("политик", "policy")),
    ("Manual", ("руководств", "manual")),
    ("Procedure", ("процедур", "procedure")),
)

#: Synonyms of terms in questions; at most three of a term are used.
SYNONYMS = {
    "function": ("method", "func", "def"),
    "method": ("function", "member function", "instance method"),
    "handler": ("callback", "listener", "hook"),
    "class": ("type", "struct", "interface"),
    "interface": ("protocol", "contract", "abstract class"),
    "enum": ("enumeration", "constants", "choices"),
    "component": ("widget", "element", "view"),
    "hook": ("use hook", "custom hook", "react hook"),
    "props": ("properties", "attributes", "parameters"),
    "state": ("local state", "component state", "useState"),
    "endpoint": ("route", "api endpoint", "url"),
    "controller": ("handler", "view", "api view"),
    "model": ("entity", "schema", "table"),
    "serializer": ("schema", "dto", "data transfer object"),
    "database": ("db", "storage", "persistence"),
    "query": ("sql", "select", "find"),
    "migration": ("schema change", "db migration", "alembic"),
    "authentication": ("auth", "login", "sign in"),
    "authorization": ("permissions", "access control", "rbac"),
    "token": ("jwt", "access token", "bearer token"),
    "create": ("add", "insert", "new"),
    "read": ("get", "fetch", "retrieve"),
    "update": ("edit", "modify", "change"),
    "delete": ("remove", "destroy", "drop"),
    "error": ("exception", "error handling", "catch"),
    "validation": ("validate", "check", "verify"),
}

#: Terms of a framework; at most two of a term are used.
FRAMEWORK_TERMS = {
    "django": {
        "view": ("viewset", "apiview"),
        "model": ("django model", "orm model"),
        "form": ("modelform", "django form"),
        "admin": ("django admin", "admin site"),
        "middleware": ("django middleware",),
        "signal": ("django signal", "post_save"),
    },
    "fastapi": {
        "endpoint": ("path operation", "route"),
        "dependency": ("depends", "fastapi depends"),
        "schema": ("pydantic model", "basemodel"),
        "middleware": ("fastapi middleware",),
    },
    "react": {
        "component": ("functional component", "class component"),
        "hook": ("usestate", "useeffect"),
        "context": ("react context", "createcontext"),
        "redux": ("store", "reducer"),
    },
}

#: Abbreviations that are spelt out where they stand as a word.
ABBREVIATIONS = {
    "api": "application programming interface",
    "ui": "user interface",
    "ux": "user experience",
    "db": "database",
    "orm": "object relational mapping",
    "jwt": "json web token",
    "dto": "data transfer object",
    "crud": "create read update delete",
    "rest": "representational state transfer",
    "http": "hypertext transfer protocol",
    "url": "uniform resource locator",
    "sql": "structured query language",
    "css": "cascading style sheets",
    "html": "hypertext markup language",
    "json": "javascript object notation",
    "xml": "extensible markup language",
    "tsx": "typescript jsx",
    "jsx": "javascript xml",
}

#: What a repository scan leaves out (a trailing slash marks a directory).
IGNORED = (
    "node_modules/", "vendor/", "venv/", "env/", ".venv/", "__pycache__/", "*.pyc", ".Python", "pip-log.txt",
    "pip-delete-this-directory.txt", "dist/", "build/", ".next/", "out/", "target/", "*.egg-info/", ".vscode/",
    ".idea/", "*.swp", "*.swo", "*~", ".DS_Store", ".git/", ".svn/", ".hg/", "*.so", "*.dylib", "*.dll", "*.exe",
    "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js", "*.map", "package-lock.json", "yarn.lock", "poetry.lock",
    "Pipfile.lock", "Cargo.lock", "*.log", "logs/", "coverage/", ".coverage", ".nyc_output/", ".env", ".env.local",
    ".env.*.local", "*.jpg", "*.jpeg", "*.png", "*.gif", "*.svg", "*.ico", "*.pdf", "*.zip", "*.tar.gz",
)

#: Fragments of paths that hold no code to index.
SKIPPED_FRAGMENTS = (
    "node_modules", "venv", ".venv", "dist", "build", "__pycache__",
)

#: Language by extension.
LANGUAGE_OF = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "java": "java",
    "go": "go",
    "rs": "rust",
    "rb": "ruby",
    "php": "php",
    "cs": "csharp",
    "cpp": "cpp",
    "c": "c",
}

#: Marks of a web framework in a Python file: two or more, and more than the other's, decide.
DJANGO_MARKS = (
    "from django.",
    "import django",
    "from rest_framework",
    "import rest_framework",
    "@api_view",
    "APIView",
    "ViewSet",
    "ModelSerializer",
)
FASTAPI_MARKS = (
    "from fastapi",
    "import fastapi",
    "FastAPI(",
    "@app.get",
    "@app.post",
    "@router.get",
    "@router.post",
    "APIRouter",
)
