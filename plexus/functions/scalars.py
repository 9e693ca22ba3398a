"""Column functions over names, paths, scores and lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a name security sensitive.
SECURITY_WORDS = (
    "auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "query", "execute", "connect",
    "socket", "request", "http", "sanitize", "validate", "encrypt", "decrypt", "hash", "sign", "verify", "admin", "privilege",
)
# Names of entry points.
ENTRY_NAMES = (
    "main", "__main__", "handler", "handle", "lambda_handler", "upgrade", "downgrade", "lifespan", "get_db",
    "do_GET", "do_POST", "do_PUT", "do_DELETE", "do_PATCH", "do_HEAD", "do_OPTIONS", "log_message",
)
# Extensions of languages, those of two parts first.
LANGUAGES = {
    ".d.ts": "typescript", ".tf.json": "terraform", ".rs": "rust", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h": "cpp", ".tf": "terraform",
}


def security_sensitive(*names: Column) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | F.lower(n).rlike("|".join(SECURITY_WORDS))
    return found


def conventional_entry(name: Column) -> Column:
    return name.isin(*ENTRY_NAMES) | name.rlike("^(on_|handle_)")


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for end, name in reversed(LANGUAGES.items()):
        out = F.when(path.endswith(end), F.lit(name)).otherwise(out)
    return out


def dependency_package(path: Column) -> Column:
    """The vendored package of a path, else null."""
    return F.nullif(F.regexp_extract(path, r"^\.cargo/vendor/([^/]+)/.+", 1), F.lit(""))


def safe_path(path: Column) -> Column:
    return (F.octet_length(path) <= 1024) & ~path.rlike(r"^/|\\|[\x00-\x1f\x7f]|(^|/)(\.{1,2})?(/|$)")


def score_text(score: Column) -> Column:
    return F.format_string("%d.%04d", F.floor(score / 10000), score % 10000)


def line_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))


def hunk_span(header: Column) -> Column:
    """Doubled span of the new side of a hunk header; an empty side is the anchor after its line."""
    part = lambda i: F.regexp_extract(header, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", i)
    first = F.nullif(part(1), F.lit("")).cast("long")
    rows = F.coalesce(F.nullif(part(2), F.lit("")).cast("long"), F.lit(1))
    start = F.when(rows == 0, 2 * first + 1).otherwise(2 * first)
    return F.struct(start.alias("start"), F.when(rows == 0, 2 * first + 1).otherwise(2 * (first + rows - 1)).alias("end"))


def requirement_tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"(?<![A-Za-z0-9_-])([A-Z][A-Z0-9_]*-\d+)(?![A-Za-z0-9_-])"), F.lit(1))


def digest_tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"(?<![0-9A-Za-z])((?:sha1:|sha256:|blake3:)?(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}))(?![0-9A-Za-z])"), F.lit(1))


def inline_links(line: Column) -> Column:
    """Targets of Markdown links: first word, angle brackets off."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"\]\(([^)]*)\)"), F.lit(1)), lambda t: F.regexp_replace(F.element_at(F.split(F.trim(t), r"\s+"), 1), "^<|>$", ""))


def analyzer(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end.isin("md", "markdown"), "markdown").when(end == "tsv", "tsv").otherwise("generic")


def provider_source(source: Column) -> Column:
    """Lower case, with the default registry in front of two-part sources, and without its standard port."""
    s = F.lower(F.trim(source))
    s = F.when(F.size(F.split(s, "/")) == 2, F.concat(F.lit("registry.terraform.io/"), s)).otherwise(s)
    return F.regexp_replace(s, "^([^/:]+):443/", "$1/")


def framed_hash(*fields: Column) -> Column:
    """sha-256 over the fields, each after its length in bytes."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.octet_length(F.coalesce(f.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(f.cast("string"), F.lit(""))) for f in fields]), 256)


def shorten(value: Column, limit: int) -> Column:
    """At most ``limit`` bytes of a text at a character's border, with an ellipsis if anything is cut."""
    ends = F.transform(F.sequence(F.lit(0), F.least(F.char_length(value), F.lit(limit))), lambda i: F.when(F.octet_length(F.substring(value, F.lit(1), i)) <= limit, i))
    return F.when(F.octet_length(value) <= limit, value).otherwise(F.concat(F.substring(value, F.lit(1), F.array_max(ends)), F.lit("…")))


def escaped(value: Column) -> Column:
    """Control characters as visible escapes: short ones where there are, else the code point in braces."""
    out = value
    for char, text in (("\t", "t"), ("\n", "n"), ("\r", "r")):
        out = F.replace(out, F.lit(char), F.lit("\\" + text))
    code = lambda ch: F.coalesce(F.nullif(F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "^0+", ""), F.lit("")), F.lit("0"))
    control = r"[\x00-\x1f\x7f-\x9f]"
    marked = F.transform(F.split(out, ""), lambda ch: F.when(ch.rlike(control), F.concat(F.lit("\\u{"), code(ch), F.lit("}"))).otherwise(ch))
    return F.when(out.rlike(control), F.array_join(marked, "")).otherwise(out)


def dot_escaped(value: Column) -> Column:
    """A quoted string of the DOT language: backslash, quote, line end and tab escaped, other controls replaced."""
    out = value
    for char, text in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(text))
    return F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "\ufffd")


def normal_path(path: Column) -> Column:
    """A path without empty and . parts, each .. taking back a part; null where that leads out. Absolute paths stay so."""
    walked = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda held, part: F.when(part.isin("", "."), held).when(part != "..", F.array_append(held, part)).when(F.coalesce(F.size(held) > 0, F.lit(False)), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))),
    )
    return F.when(walked.isNotNull(), F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/")))


def repository_relative(name: Column, root: Column) -> Column:
    """The path of a coverage report's file below the root of the work tree; null if it is outside or no safe path."""
    whole = normal_path(F.when(name.startswith("/"), name).otherwise(F.concat(root, F.lit("/"), name)))
    base = F.concat(normal_path(root), F.lit("/"))
    inside = F.when(whole.startswith(base), F.substring(whole, F.char_length(base) + 1, F.char_length(whole)))
    return F.when(safe_path(inside), inside)


def joined_names(parent: Column, name: Column, limit: int = 1024) -> Column:
    """parent::name, or the one that isn't empty; null over ``limit`` bytes."""
    out = F.concat_ws("::", F.nullif(parent, F.lit("")), F.nullif(name, F.lit("")))
    return F.when(F.octet_length(out) <= limit, out)


def without_generics(name: Column) -> Column:
    """A name without what balanced angle brackets hold; an arrow's bracket is none. Null if they don't balance."""
    chars = F.split(F.replace(name, F.lit("->"), F.lit("\x01")), "")
    walked = F.aggregate(
        chars, F.struct(F.lit("").alias("text"), F.lit(0).alias("depth")),
        lambda a, ch: F.struct(
            F.when((a["depth"] == 0) & ~ch.isin("<", ">"), F.concat(a["text"], ch)).otherwise(a["text"]).alias("text"),
            F.when(a["depth"] < 0, a["depth"]).when(ch == "<", a["depth"] + 1).when(ch == ">", a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
        ),
    )
    return F.when(walked["depth"] == 0, F.replace(walked["text"], F.lit("\x01"), F.lit("->")))


def terraform_key(folder: Column, address: Column) -> Column:
    """A lookup key that holds a folder, after its length in bytes, and an address in it."""
    return F.concat(F.lit("terraform:"), F.octet_length(folder).cast("string"), F.lit(":"), folder, F.lit(":"), address)


def terraform_address(lookup: Column) -> Column:
    """The address of a terraform_key; null of any other text. Folders may hold colons; their length tells."""
    size = F.regexp_extract(lookup, r"^terraform:(\d{1,6}):", 1)
    body = F.encode(F.regexp_replace(lookup, r"^terraform:\d{1,6}:", ""), "utf-8")
    n = F.nullif(size, F.lit("")).cast("int")
    ok = (F.octet_length(body) > n) & (F.decode(F.substring(body, n + 1, F.lit(1)), "utf-8") == ":")
    return F.when(ok, F.decode(F.substring(body, n + 2, F.octet_length(body)), "utf-8"))


def override_file(path: Column) -> Column:
    """Whether a Terraform file overrides others by its name."""
    return F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"^(.*_)?override\.tf(\.json)?$")


def inline_code(line: Column) -> Column:
    """What stands between runs of back-ticks of one length, from the left; an open run ends the search."""
    found = F.regexp_extract_all(line, F.lit(r"\G[^`]*+(`++)(.*?)\1"), F.lit(2))
    return F.when(line.contains("`"), found).otherwise(F.array().cast("array<string>"))


def reference_definition(line: Column) -> Column:
    """label, target of a Markdown reference definition; null if the line is none."""
    part = lambda i: F.regexp_extract(line, r"^ *\[([^\]]+(?:\](?!: )[^\]]*)*)\]: \s*<?([^\s>]*)", i)
    return F.when(part(1) != "", F.struct(part(1).alias("label"), part(2).alias("target")))


def symbol_name(symbol: Column) -> Column:
    """The name in a symbol's last descriptor (type#, term., method()., macro!), unquoted; null if local or nameless."""
    end = r"(?:\([^(]*\)\.|(?<!\))\.|[#!])\z"
    part = lambda i: F.nullif(F.regexp_extract(symbol, rf"(?:(?<!`)`([^`]+)`|([\p{{IsAlphabetic}}\p{{N}}_+\-$]+)){end}", i), F.lit(""))
    return F.when(~symbol.startswith("local "), F.coalesce(part(1), part(2)))
