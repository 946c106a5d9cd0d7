"""Lists, maps and constants that results depend on."""

#: Media types by suffix; the code map is looked up first, by the suffix as it is and in lower case.
CODE_MEDIA = {
    ".py": "text/x-code-python", ".pyi": "text/x-code-python", ".js": "text/x-code-javascript", ".jsx": "text/x-code-jsx", ".mjs": "text/x-code-javascript", ".cjs": "text/x-code-javascript", ".ts": "text/x-code-typescript", ".tsx": "text/x-code-tsx",
    ".css": "text/x-code-css", ".scss": "text/x-code-scss", ".sass": "text/x-code-sass", ".less": "text/x-code-less", ".vue": "text/x-code-vue", ".svelte": "text/x-code-svelte", ".astro": "text/x-code-astro", ".java": "text/x-code-java",
    ".c": "text/x-code-c", ".h": "text/x-code-c", ".cpp": "text/x-code-cpp", ".cc": "text/x-code-cpp", ".cxx": "text/x-code-cpp", ".hpp": "text/x-code-cpp", ".rs": "text/x-code-rust", ".go": "text/x-code-go", ".rb": "text/x-code-ruby", ".php": "text/x-code-php", ".swift": "text/x-code-swift",
    ".kt": "text/x-code-kotlin", ".kts": "text/x-code-kotlin", ".scala": "text/x-code-scala", ".sh": "text/x-code-shell", ".bash": "text/x-code-shell", ".zsh": "text/x-code-shell", ".fish": "text/x-code-shell", ".sql": "text/x-code-sql", ".r": "text/x-code-r", ".R": "text/x-code-r",
    ".jl": "text/x-code-julia", ".lua": "text/x-code-lua", ".pl": "text/x-code-perl", ".ex": "text/x-code-elixir", ".exs": "text/x-code-elixir", ".erl": "text/x-code-erlang", ".hrl": "text/x-code-erlang", ".fs": "text/x-code-fsharp", ".fsx": "text/x-code-fsharp", ".cs": "text/x-code-csharp",
    ".clj": "text/x-code-clojure", ".cljs": "text/x-code-clojure", ".hs": "text/x-code-haskell", ".ml": "text/x-code-ocaml", ".mli": "text/x-code-ocaml",
}
TEXT_MEDIA = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".mdx": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html",
    ".xhtml": "application/xhtml+xml", ".xml": "application/xml", ".json": "application/json", ".jsonl": "application/x-ndjson", ".ndjson": "application/x-ndjson",
    ".yaml": "application/yaml", ".yml": "application/yaml", ".toml": "application/toml", ".csv": "text/csv", ".tsv": "text/tab-separated-values",
}
#: Media types besides text/ that can be indexed as files; as derivatives the last one can't.
INDEXABLE_MEDIA = ("application/json", "application/x-ndjson", "application/xml", "application/yaml", "application/toml", "application/xhtml+xml")

#: Files that count as text, by suffix in lower case or by name.
TEXT_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".kts", ".scala", ".cs",
    ".m", ".mm", ".lua", ".pl", ".pm", ".r", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".bat", ".cmd", ".md", ".markdown", ".rst", ".txt", ".adoc", ".org", ".tex",
    ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".csv", ".tsv", ".sql", ".dockerfile",
    ".containerfile", ".makefile", ".gradle", ".cmake", ".tf", ".hcl",
)
TEXT_NAMES = ("Makefile", "Dockerfile", "Containerfile", "Rakefile", "Gemfile", "Procfile", "Vagrantfile", "Justfile", ".gitignore", ".dockerignore", ".editorconfig", ".env.example")
EXCLUDED_DIRS = (".marlstone", ".git", ".venv", "venv", "node_modules", "__pycache__")
MAX_FILE_BYTES = 1_000_000

LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".rs": "rust"}

#: Weights of content, metadata, terms and graph by intent, and the words that tell the intent, in this order.
INTENT_WEIGHTS = {"code": (0.4, 0.25, 0.25, 0.1), "history": (0.2, 0.2, 0.3, 0.3), "structural": (0.15, 0.15, 0.2, 0.5), "conceptual": (0.35, 0.35, 0.15, 0.15)}
DEFAULT_WEIGHTS = (0.35, 0.25, 0.25, 0.15)
STRUCTURAL_WORDS = ("calls", "depends", "imports", "inherits", "uses", "what calls", "who calls", "what uses", "depends on", "impact", "affect")
HISTORY_WORDS = ("changed", "modified", "commit", "who changed", "when did", "history", "blame", "author", "last change", "recently")

#: Constants of the two rankings.
FTS_K1, FTS_B, FTS_LEAST_IDF = 1.2, 0.75, 1e-6
OKAPI_K1, OKAPI_B, OKAPI_EPSILON = 1.5, 0.75, 0.25

#: Symbol patterns of JavaScript lines; the first that matches counts.
JS_SYMBOLS = (
    (r"^\s*export\s+default\s+function\s+([A-Za-z_$][\w$]*)", "function"),
    (r"^\s*export\s+function\s+([A-Za-z_$][\w$]*)", "function"),
    (r"^\s*function\s+([A-Za-z_$][\w$]*)", "function"),
    (r"^\s*export\s+class\s+([A-Za-z_$][\w$]*)", "class"),
    (r"^\s*class\s+([A-Za-z_$][\w$]*)", "class"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "function"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?function", "function"),
)

#: Shapes of nodes in flowcharts.
SHAPES = {"class": ("[", "]"), "module": ("[[", "]]"), "function": ("(", ")"), "method": ("(", ")"), "import": ("{{", "}}")}
MAX_NODES, MAX_EDGES, MAX_LABEL, MAX_LEVELS = 500, 2000, 60, 100

#: What is made of each kind of derivative: table, and whether chunks of text go to the term index.
MATERIALIZERS = {
    "extracted_markdown": "paragraph_chunks", "table": "table_store", "figure": "figure_index", "image": "image_registry",
    "reference": "reference_graph", "code_symbol": "code_graph", "style_rule": "style_rule_index",
}
#: Texts of table cells that are numbers, after commas have gone.
INTEGER, REAL = r"[-+]?\d+", r"[-+]?(?:\d+\.\d*|\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
#: Lines of Markdown: the title of a list of references, the start of an entry, any heading.
REFERENCES_TITLE, ENTRY_START, ANY_HEADING = r"^\s*(?:#{1,6}\s*)?(?:references|bibliography)\s*$", r"^\s*(?:[-*]|\[?\d+\]?\.?|\d+\))\s+", r"^\s*#{1,6}\s+"
