"""Column expressions for paths, names, identities and text; all stay in the JVM."""

from __future__ import annotations

import mimetypes
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import fixed


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a key in a fixed map, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


# paths


def suffix(path: Column | str) -> Column:
    """Last suffix with its dot; none for names that begin or end with their only dot."""
    return F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def is_text_file(path: Column | str) -> Column:
    return base_name(path).isin(*fixed.TEXT_NAMES) | F.lower(suffix(path)).isin(*fixed.TEXT_SUFFIXES)


def media_type(path: Column | str) -> Column:
    code = fixed.CODE_MEDIA
    own, low = suffix(path), F.lower(suffix(path))
    known = {k: v for k, v in mimetypes.MimeTypes(filenames=()).types_map[1].items() if k not in fixed.TEXT_MEDIA and k not in code}
    return F.coalesce(lookup(code, own), lookup(code, low), lookup(fixed.TEXT_MEDIA, low), lookup(known, low), F.lit("application/octet-stream"))


def is_code_media(media: Column | str) -> Column:
    return col(media).startswith("text/x-code-")


def language(path: Column | str) -> Column:
    return lookup(fixed.LANGUAGES, suffix(path))


def indexable(media: Column | str, derivative: bool = False) -> Column:
    """Whether content of a media type can be indexed; XHTML can as a file, but not as a derivative."""
    return col(media).startswith("text/") | col(media).isin(*fixed.INDEXABLE_MEDIA[: -1 if derivative else None])


def index_state(media: Column | str, derivative: bool = False) -> Column:
    return F.when(indexable(media, derivative), "indexable").otherwise("raw")


def partition_key(path: Column | str) -> Column:
    """First folder of a path, or _root."""
    return F.when(col(path).contains("/"), F.split(col(path), "/", 2)[0]).otherwise("_root")


def partition_hash(key: Column | str) -> Column:
    return F.substring(F.sha2(col(key), 256), 1, 12)


def is_below(path: Column | str, folder: Column | str) -> Column:
    return (col(path) == col(folder)) | col(path).startswith(F.concat(col(folder), F.lit("/")))


def glob_regex(pattern: str) -> str:
    """Shell pattern as a regular expression for the whole text; * crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = end + 1
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
    return f"(?s)^{out}$"


def matches_glob(text: Column | str, pattern: str) -> Column:
    return F.coalesce(col(text).rlike(glob_regex(pattern)), F.lit(False))


# identities


def chunk_id(path: Column | str, start: Column | str, end: Column | str, content: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(col(path), F.lit(":"), col(start).cast("string"), F.lit(":"), col(end).cast("string"), F.lit(":"), col(content)), 256), 1, 16)


def file_handle(content: Column | str) -> Column:
    return F.concat(F.lit("hf_"), F.sha2(col(content), 256))


def sorted_json(**members: Column) -> Column:
    """A compact JSON object with sorted keys, nulls included; maps are sorted by key too."""
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]), {"ignoreNullFields": "false"})


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def derivative_handle(media: Column, derivative_type: Column, content: Column, metadata: Column, role: Column | None = None, state: Column | None = None) -> Column:
    """Identity of derived content: equal content made in the same way has the same handle. metadata: map of strings."""
    whole = sorted_json(kind=F.lit("derivative"), content_type=media, role=F.lit("artifact") if role is None else role, index_state=index_state(media, True) if state is None else state, derivative_type=derivative_type, metadata=sorted_map(metadata), content_sha256=F.sha2(content, 256))
    return F.concat(F.lit("h_"), F.sha2(whole, 256))


def collection_handle(members: Column, derivative_type: Column, metadata: Column, role: Column | None = None) -> Column:
    """Identity of an ordered collection. members: array of structs whose fields are in order of name."""
    whole = sorted_json(kind=F.lit("collection"), role=F.lit("artifact") if role is None else role, derivative_type=derivative_type, metadata=sorted_map(metadata), members=members)
    return F.concat(F.lit("hc_"), F.sha2(whole, 256))


# names


def visibility(name: Column | str) -> Column:
    name = col(name)
    return F.when(name.startswith("__") & ~name.endswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


def metadata_text(m: Column) -> Column:
    """Searchable lines of a unit's metadata, a line for each field that says something."""
    some = lambda x: x.isNotNull() & (x != "")
    some_of = lambda x: x.isNotNull() & (F.size(x) > 0)
    calls = F.transform(m["calls_made"], lambda c: F.coalesce(F.nullif(c["resolved_unit_id"], F.lit("")), c["raw"]))
    head = F.concat(m["kind"], F.when(some(m["name"]), F.concat(F.lit(" "), m["name"])).otherwise(""), F.when(m["parameters"].isNotNull(), F.concat(F.lit("("), F.array_join(m["parameters"], ", "), F.lit(")"))).otherwise(""), F.when(some(m["return_type"]), F.concat(F.lit(" -> "), m["return_type"])).otherwise(""))
    line = lambda label, value, there: F.when(there, F.concat(F.lit(f"  {label}: "), value))
    return F.concat_ws(
        "\n", head, F.when(some(m["parent_name"]) & some(m["parent_kind"]), F.concat(F.lit("  in "), m["parent_kind"], F.lit(" "), m["parent_name"])),
        line("qualified", m["qualified_name"], some(m["qualified_name"])), line("visibility", m["visibility"], some(m["visibility"])), line("decorators", F.array_join(m["decorators"], ", "), some_of(m["decorators"])),
        line("calls", F.array_join(calls, ", "), some_of(m["calls_made"])), line("imports used", F.array_join(m["imports_used"], ", "), some_of(m["imports_used"])),
        line("cyclomatic_branch_count", m["cyclomatic_branch_count"].cast("string"), m["cyclomatic_branch_count"].isNotNull()), line("docstring", m["docstring"], some(m["docstring"])),
    )


# text


def strip(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalized(text: Column | str) -> Column:
    """Line ends as LF, no white space around, one LF at the end; blank texts become empty."""
    bare = strip(F.regexp_replace(col(text), r"\r\n?", "\n"))
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n")))


def terms(text: Column | str) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _folding() -> tuple[str, str]:
    """Letters with marks, and what they are without, by Unicode's own decomposition."""
    pairs = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def index_terms(text: Column | str) -> Column:
    """Terms of the full-text index: marks are folded away; _ . / and - belong to terms."""
    return F.regexp_extract_all(F.translate(F.lower(col(text)), FOLD_FROM, FOLD_TO), F.lit(r"([\p{L}\p{N}\p{Co}_./-]+)"), F.lit(1))


def intent(query: Column | str) -> Column:
    """structural, history, code or conceptual, by the first kind of words found, then by the look of the query."""
    low = F.lower(col(query))
    has = lambda words: F.greatest(*[low.contains(w) for w in words])
    looks = col(query).rlike(r"[_.]") | (col(query).rlike(r"\p{Lu}") & col(query).rlike(r"\p{Ll}"))
    return F.when(has(fixed.STRUCTURAL_WORDS), "structural").when(has(fixed.HISTORY_WORDS), "history").when(looks, "code").otherwise("conceptual")
