"""Globs and path predicates. Globs become regular expressions on the driver; rows are tested by rlike in the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BRACES = 256
_ESCAPED = set(r"\.^$+()|{}[]")


def expand_braces(glob: str) -> list[str]:
    """`a{b,c}` as `ab`, `ac`; nested braces, too. Raises ValueError beyond MOST_BRACES alternatives."""
    depth, start = 0, -1
    for k, c in enumerate(glob):
        if c == "{":
            if depth == 0:
                start = k
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                options, part, inner = [], "", 0
                for x in glob[start + 1 : k]:
                    inner += (x == "{") - (x == "}")
                    if x == "," and inner == 0:
                        options.append(part)
                        part = ""
                    else:
                        part += x
                found = [y for o in [*options, part] for y in expand_braces(glob[:start] + o + glob[k + 1 :])]
                if len(found) > MOST_BRACES:
                    raise ValueError(f"more than {MOST_BRACES} alternatives: {glob!r}")
                return found
    return [glob]


def _regex(glob: str, star: str) -> str:
    """`glob` without braces as a regular expression; `star` is what a single star stands for."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            run = len(re.match(r"\*+", glob[k:])[0])
            if run > 1 and glob[k + run : k + run + 1] == "/" and (k == 0 or glob[k - 1] == "/"):
                out, k = out + "(?:.*/)?", k + run + 1
                continue
            out, k = out + (".*" if run > 1 else star), k + run
            continue
        if c == "[" and (end := glob.find("]", k + 2)) > 0:
            inside = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
            continue
        out += "[^/]" if c == "?" else "\\" + c if c in _ESCAPED else c
        k += 1
    return out


def include_regex(glob: str) -> str:
    """A regular expression for an including glob: a star crosses folders."""
    return "^(?:" + "|".join(_regex(g, ".*") for g in expand_braces(glob)) + ")$"


def normal_glob(glob: str) -> str:
    """A path glob that matches at any depth: with a leading / or ** as it is; `dir/` all below; a bare name itself and all below."""
    if glob.startswith(("/", "**")):
        return glob
    if glob.endswith("/"):
        return f"**/{glob}**"
    return f"**/{glob}" if re.search(r"[*?\[{]", glob) else f"**/{glob}{{,/**}}"


def exclude_regex(glob: str) -> str:
    """A regular expression for an excluding glob: a star stays in its folder; the glob floats to any depth and takes all below what it names."""
    out = []
    for g in expand_braces(glob.strip().lstrip("/")):
        g = g.rstrip("/")
        out.append("(?:.*/)?" + _regex(g, "[^/]*") + "(?:/.*)?")
    return "^(?:" + "|".join(out) + ")$"


def included(path: Column, glob: str | None) -> Column:
    return F.lit(True) if not glob else path.rlike(include_regex(normal_glob(glob)))


def excluded(path: Column, glob: str | None) -> Column:
    return F.lit(False) if not glob else path.rlike(exclude_regex(glob))


def literal_prefix(glob: str) -> str:
    """What every match of an anchored glob begins with; a startswith on it reaches the scan."""
    return re.split(r"[*?\[{]", glob)[0]


def foreign_worktree(path: Column, own: str | None = None) -> Column:
    """Paths below .claude/worktrees of another worktree than `own`."""
    name = F.regexp_extract(path, r"(?:^|/)\.claude/worktrees/([^/]+)", 1)
    return (name != "") & (name != F.lit(own or ""))


def component_matches(component: Column, wanted: str) -> Column:
    """The component itself, or one below it in dotted names."""
    return (component == wanted) | component.startswith(wanted + ".")


def below_prefix(path: Column, prefix: str) -> Column:
    """Whether a library path is `prefix` or below it; slashes at its ends do not matter."""
    p = prefix.strip("/")
    return F.lit(True) if not p else (path == p) | path.startswith(p + "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]+)$", 1))


#: Extensions by class. Fixed values.
CLASSES = {
    "code": "rs py js jsx ts tsx go java kt kts scala c h cc cpp hpp cs rb php swift m mm lua r jl sh bash zsh pl sql hs ml ex exs erl clj dart zig",
    "docs": "md markdown rst txt adoc pdf docx doc odt rtf epub html htm tex",
    "config": "toml yaml yml ini cfg conf env properties",
    "data": "csv tsv parquet jsonl ndjson xlsx xls xml avro orc json",
    "build": "lock gradle cmake mk tgz whl jar",
    "image": "png jpg jpeg gif webp svg bmp ico",
    "web": "css scss sass less vue svelte",
    "notebook": "ipynb",
}


def file_class(path: Column) -> Column:
    """Dot files without another extension are config; json is config where its path speaks of one, else data; tarballs are build; else by extension, else other."""
    ext, low = extension(path), F.lower(path)
    out = F.when(base_name(path).rlike(r"^\.[^.]+$"), "config").when(low.rlike(r"\.tar\.(gz|bz2|xz|zst)$"), "build")
    out = out.when((ext == "json") & low.rlike(r"config|settings|package\.json$|tsconfig|\.rc"), "config")
    for name, all_ in CLASSES.items():
        out = out.when(ext.isin(*all_.split()), name)
    return out.otherwise("other")


def is_test_file(path: Column) -> Column:
    """Code files named like tests, or below a test folder."""
    stem = F.regexp_replace(base_name(path), r"\.[^.]+$", "")
    ext = extension(path)
    named = stem.rlike(r"(?i)^test_|_test$|\.(test|spec)$|^conftest$") | (ext.isin("java", "kt", "scala") & stem.rlike(r"(Test|Tests|IT|Spec)$"))
    folder = F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec|specs)/")
    return ext.isin(*CLASSES["code"].split()) & (named | folder)


#: Hosts that an ingest must not ask: names of this machine, and IPv4 and IPv6 ranges that are not public (this network, private, shared, loopback, link-local, unique local, mapped IPv4). Fixed values.
PRIVATE_HOSTS = (
    r"localhost", r"[^/]*\.localhost", r"[^/]*\.local", r"[^/]*\.internal",
    r"0(?:\.\d+){3}", r"10(?:\.\d+){3}", r"100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])(?:\.\d+){2}", r"127(?:\.\d+){3}", r"169\.254(?:\.\d+){2}", r"172\.(?:1[6-9]|2\d|3[01])(?:\.\d+){2}", r"192\.168(?:\.\d+){2}",
    r"\d+", r"0x[0-9a-f]+", r"\[::1?\]", r"\[f[cd][0-9a-f]*:[^\]]*\]", r"\[fe[89ab][0-9a-f]:[^\]]*\]", r"\[::ffff:[^\]]*\]",
)


def url_host(url: Column) -> Column:
    """The host of an http(s) address in lower case, without user and port; empty for other addresses."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))


def public_url(url: Column) -> Column:
    """Whether an address is http(s) and its host is none of PRIVATE_HOSTS, as far as its name tells; what a name resolves to is to be asked again before a fetch."""
    host = F.regexp_replace(url_host(url), r"\.$", "")
    return F.coalesce((host != "") & ~host.rlike("^(?:" + "|".join(PRIVATE_HOSTS) + ")$"), F.lit(False))
