"""Text functions: tokens, identifiers, cases, clean-up, titles, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at which BM25 terms are parted, beside white space. Fixed value.
TERM_MARKS = "()[]{}<>\"'`.,:;~!@#$%^&*+=|\\"
_SPLIT = "[\\s" + "".join("\\" + c for c in TERM_MARKS) + "]+"
_JUNK = r"^[0-9a-f]{8,}$|^v?[0-9]+(\.[0-9]+)+$|[/\\]|^0x|^[0-9]+$"


def identifier_parts(token: Column) -> Column:
    """Parts of an identifier at `_`, `-` and changes of case, in lower case."""
    parts = F.split(token, r"[_\-]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.filter(F.transform(parts, lambda x: F.lower(x)), lambda x: F.octet_length(x) > 1)


def terms(text: Column) -> Column:
    """BM25 terms: parted at white space and marks, trimmed of `-_/`, of two bytes or more, lower case, without junk (hashes, versions, paths, numbers); compound identifiers give their parts, too."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda x: F.regexp_replace(x, r"^[-_/]+|[-_/]+$", ""))
    raw = F.filter(raw, lambda x: F.octet_length(x) > 1)
    good = lambda x: ~x.rlike(_JUNK)
    whole = F.filter(F.transform(raw, lambda x: F.lower(x)), good)
    compound = F.filter(raw, lambda x: ~x.contains("/") & (F.size(identifier_parts(x)) >= 2))
    parts = F.filter(F.flatten(F.transform(compound, identifier_parts)), good)
    return F.concat(whole, parts)


def raw_tokens(text: Column) -> Column:
    """What stands between white space and marks, as an array."""
    return F.split(F.coalesce(text, F.lit("")), _SPLIT)


def terms_of_token(token: Column) -> Column:
    """The terms of one raw token, as terms() of a text gives them. Only tokens with a sign of parts are looked at closer."""
    t = F.when(token.rlike(r"^[-_/]|[-_/]$"), F.regexp_replace(token, r"^[-_/]+|[-_/]+$", "")).otherwise(token)
    none = F.array().cast("array<string>")
    good = lambda x: ~x.rlike(_JUNK)
    low = F.lower(t)
    whole = F.when(good(low), F.array(low)).otherwise(none)
    parts = F.when(t.rlike(r"[_\-]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]") & ~t.contains("/"), identifier_parts(t)).otherwise(none)
    both = F.when(F.size(parts) >= 2, F.concat(whole, F.filter(parts, good))).otherwise(whole)
    return F.when(F.octet_length(t) > 1, both).otherwise(none)


def kebab(text: Column) -> Column:
    """Lower case, words joined by hyphens."""
    spaced = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", "-")
    return F.regexp_replace(F.regexp_replace(F.lower(spaced), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def cleaned(text: Column) -> Column:
    """Without control characters but line ends and tabs; runs of other white space are one space; lines stay."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(out, r"[^\S\n]+", " "))


#: Titles that programs give to new files, alone and numbered. Fixed values.
PLACEHOLDERS = ("untitled", "document", "presentation", "slide", "book", "new document", "noname")
_NUMBERED = r"(?i)^(microsoft\s+word\s*[-–—]\s*|document|presentation|slide|book|untitled)\s*\d*$"


def accepted_title(title: Column) -> Column:
    """`title` trimmed, null if it is empty or a placeholder."""
    t = F.trim(title)
    return F.when((t != "") & ~F.lower(t).isin(*PLACEHOLDERS) & ~t.rlike(_NUMBERED) & ~F.lower(t).startswith("microsoft word"), t)


def name_title(path: Column) -> Column:
    """The file's name without its extension, `_` and `-` as spaces, each word with a capital; Untitled without a name."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    words = F.filter(F.split(F.translate(name, "_-", "  "), r"\s+"), lambda w: w != "")
    made = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    return F.when(name != "", made).otherwise(F.lit("Untitled"))


def document_title(metadata: Column, text: Column, path: Column, kind: Column) -> tuple[Column, Column]:
    """A document's title and where it comes from: its metadata unless a placeholder, what its text begins with (by `kind`: html, markdown or plain), its file's name."""
    content = F.when(kind == "html", html_title(text)).when(kind == "markdown", markdown_title(text)).otherwise(plain_title(text))
    given = accepted_title(metadata)
    source = F.when(given.isNotNull(), "metadata").when(content.isNotNull(), "content").otherwise("file name")
    return F.coalesce(given, content, name_title(path)), source


def html_title(html: Column) -> Column:
    """<title>, else og:title, else the first <h1> without its tags."""
    flat = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " ")), F.lit(""))
    return F.coalesce(
        flat(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        flat(F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""", 1)),
        flat(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
    )


def markdown_title(text: Column) -> Column:
    """Front matter's title, else the first `# ` line before other text."""
    front = F.regexp_extract(text, r"""(?s)^---\n.*?^?title:[ ]*["']?([^\n"']+)""", 1)
    head = F.regexp_extract(text, r"^(?:---\n(?s:.*?)\n---\n)?\s*# ([^\n]+)", 1)
    return F.coalesce(F.nullif(F.trim(front), F.lit("")), F.nullif(F.trim(head), F.lit("")))


def plain_title(text: Column) -> Column:
    """The first line that is not blank, if it is short, holds a capital and does not end like a sentence; no second line is tried."""
    line = F.trim(F.regexp_extract(text, r"^\s*([^\n]*)", 1))
    return F.when((line != "") & (F.octet_length(line) <= 200) & ~line.rlike(r"[.,;]$") & line.rlike(r"\p{Lu}"), line)


#: Tokens that are secrets by their shape. Fixed values.
SECRETS = {
    "aws": r"\bAKIA[0-9A-Z]{16}\b",
    "github": r"\b(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{20,}\b",
    "gitlab": r"\bglpat-[A-Za-z0-9_\-]{20,}\b",
    "slack": r"\bxox[abprs]-[A-Za-z0-9\-]{10,}\b",
    "openai": r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{20,}\b",
    "stripe": r"\bsk_(?:live|test)_[A-Za-z0-9]{10,}\b",
    "google": r"\bAIza[0-9A-Za-z_\-]{35}\b",
    "sendgrid": r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}\b",
    "npm": r"\bnpm_[A-Za-z0-9]{36}\b",
    "hugging_face": r"\bhf_[A-Za-z0-9]{30,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b",
}
#: Words at the end of a key, or in an element's name, whose value is a credential; values that only stand for one; sentences. Fixed values.
_KEY = r"""(?i)^(\s*(?:export\s+)?(?:-\s+)?["']?[\w.\-\[\]]*?(?:password|passwd|pwd|passphrase|(?:^|[\s_\-.])pass|secret|api[_\-]?key|apikey|access[_\-]?key|private[_\-]?key|token|credentials?)["']?\s*[:=]\s*)(.*)$"""
_ELEMENT = r"""(?i)(<(?:[\w.\-]*:)?[\w.\-]*(?:password|passwd|secret|api[_\-]?key|apikey|token|credentials?)(?:\s[^>]*)?>)"""
_HARMLESS = (
    r"(?i:true|false|null|nil|none|yes|no|on|off|[+-]?\d+(?:\.\d+)?|\$\{.*\}|\$[A-Za-z_][A-Za-z0-9_]*|\$\(.*\)|%[A-Za-z_][A-Za-z0-9_]*%|\{\{.*\}\}|<[^<>]+>|\[[^\[\]]*\]|\*+|x{3,}|\.{3,}"
    r"|(?:var|local|data|module|env|secrets?|vault|ref|self|this|config|settings)\.[\w.\-]+|[\w.\-]*\(.*\)|change[_\-]?me|changeit|your[_\-][\w\-]*|to[_\-]?do|todo|tbd|placeholder|example|sample|dummy|fixme)"
)
_PROSE = r"\p{L}[\p{L}\p{M}'’.,;:!?()\-]*(?:\s+\p{L}[\p{L}\p{M}'’.,;:!?()\-]*)+"
#: An address with a password, and the two ends of a private key. Fixed values.
_ADDRESS = r"""([a-zA-Z][a-zA-Z0-9+.\-]*://[^\s:/@"']+:)"""
_BEGIN, _END = r"^\s*-{5}BEGIN [A-Z0-9 ]*PRIVATE KEY-{5}", r"^\s*-{5}END [A-Z0-9 ]*PRIVATE KEY-{5}"
#: Extensions of files of settings. Fixed values.
SETTINGS = ("properties", "conf", "cfg", "ini", "cnf", "toml", "yaml", "yml", "json", "jsonc", "json5", "xml", "plist", "xcconfig", "tf", "tfvars", "hcl", "env", "example", "sample", "template", "dist")
#: Folders of translations, where such a value is a label. Fixed values.
TRANSLATIONS = ("i18n", "l10n", "locale", "locales", "lang", "langs", "translation", "translations", "messages")
MARK = "<redacted>"


def holds_settings(path: Column) -> Column:
    """Whether a file's lines are settings, so that the value of a key that names a credential is one; not so in translations."""
    parts = F.transform(F.split(path, "/"), F.lower)
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    settings = name.startswith(".env") | F.regexp_extract(name, r".\.([^.]*)$", 1).isin(*SETTINGS)
    return settings & ~F.arrays_overlap(folders, F.array(*map(F.lit, TRANSLATIONS)))


def _without_value(line: Column) -> Column:
    """A line of settings without the credential in it; null if there is none."""
    # what begins with a quote has a comment only behind the closing one
    value = r"""^((?:"[^"]*(?:"|$)|'[^']*(?:'|$))?(?:(?! #| //).)*)(.*)$"""
    before, whole = F.regexp_extract(line, _KEY, 1), F.regexp_extract(line, _KEY, 2)
    given = F.rtrim(F.regexp_replace(F.regexp_extract(whole, value, 1), r"\s+$", ""))
    end = F.regexp_extract(given, r"(\s*[,;])$", 1)
    body = F.regexp_replace(given, r"\s*[,;]$", "")
    quote = F.regexp_extract(body, r"""^(["']).*\1$""", 1)
    inner = F.trim(F.when(quote != "", F.regexp_extract(body, r"^.(.*).$", 1)).otherwise(body))
    harmless = (F.length(inner) < 4) | inner.rlike(f"^{_HARMLESS}$") | inner.rlike(f"^{_PROSE}$")
    return F.when(line.rlike(_KEY) & ~harmless, F.concat(before, quote, F.lit(MARK), quote, end, F.regexp_extract(whole, value, 2)))


def _without_tokens(line: Column) -> Column:
    out = F.regexp_replace(line, _ADDRESS + r"(?!" + _HARMLESS + r"""@)[^\s@"']{4,}@""", f"$1{MARK}@")
    marked = out
    for shape in SECRETS.values():
        marked = F.regexp_replace(marked, shape, MARK)
    # one look at a line tells whether any of the shapes is in it
    return F.when(out.rlike("|".join(SECRETS.values())), marked).otherwise(out)


def redacted(text: Column, key_values: Column | bool = True) -> Column:
    """`text` without what is secret, line by line, as the mark stands for it: lines inside private keys, passwords in addresses, tokens of known shapes and, where `key_values` holds, values of keys and elements that name a credential.

    Values that only stand for one (placeholders, variables, calls, sentences, under four characters) stay. A line whose value
    is replaced keeps its key, quotes, trailing comma and comment. Texts without any sign of a secret are not taken apart.
    """
    settings = key_values if isinstance(key_values, Column) else F.lit(key_values)
    lines = F.split(text, "\n")

    def clean(line: Column) -> Column:
        body, end = F.regexp_replace(line, "\r$", ""), F.regexp_extract(line, "(\r)$", 1)
        in_element = F.regexp_replace(body, _ELEMENT + rf"(?!\s*(?:{_HARMLESS}|{_PROSE})\s*</)(?=\s*[^<\s][^<]{{2,}}[^<\s]\s*<)[^<]{{4,}}(?=</)", f"$1{MARK}")
        return F.concat(_without_tokens(F.when(settings, F.coalesce(_without_value(body), in_element)).otherwise(body)), end)

    def keyed() -> Column:
        """The lines, those between the two ends of a private key as the mark. The text is cut before each line that begins a key, and what follows before the first line that ends one, so each line is looked at once."""
        ends = lambda x: x.rlike(_END)
        armour = lambda x: x.rlike(_BEGIN) | ends(x)
        plain = lambda xs: F.transform(xs, lambda x: F.when(armour(x), x).otherwise(clean(x)))
        marked = lambda x: F.concat(F.lit(MARK), F.regexp_extract(x, "(\r)$", 1))
        before = lambda end: r"\n(?=" + end.replace(r"^\s*", r"[^\S\n]*") + ")"

        def part(chunk: Column) -> Column:
            halves = F.split(chunk, before(_END), 2)
            inside, rest = F.split(halves[0], "\n"), F.when(F.size(halves) > 1, F.split(F.get(halves, F.lit(1)), "\n")).otherwise(F.array().cast("array<string>"))
            begun = inside[0].rlike(_BEGIN) & ~ends(inside[0])
            key = F.concat(F.slice(inside, 1, 1), F.transform(F.slice(inside, 2, F.greatest(F.lit(0), F.size(inside) - 1)), marked))
            return F.concat(F.when(begun, key).otherwise(plain(inside)), plain(rest))

        return F.flatten(F.transform(F.split(text, before(_BEGIN)), part))

    sign = text.rlike(r"(?i)pass|pwd|secret|key|token|credential|://|AKIA|gh[pousr]_|github_pat|glpat-|xox|sk[-_]|AIza|SG\.|npm_|hf_|eyJ")
    return F.when(text.contains("PRIVATE KEY-----"), F.array_join(keyed(), "\n")).when(sign, F.array_join(F.transform(lines, clean), "\n")).otherwise(text)


def accent_folded(text: Column) -> Column:
    """Latin letters without accents, in lower case."""
    return F.translate(F.lower(text), "àáâãäåèéêëìíîïòóôõöùúûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync")
