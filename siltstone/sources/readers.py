"""Readers of files into texts with metadata, and sinks of tables."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document type by extension, compound ones first. Fixed values.
TYPES = {
    "test.ts": "typescript", "d.ts": "typescript", "tar.gz": "archive",
    "md": "markdown", "markdown": "markdown", "txt": "text", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "go": "go", "java": "java", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "htm": "html", "csv": "csv", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "odt": "odt", "epub": "epub", "rtf": "rtf", "ipynb": "notebook", "xlsx": "spreadsheet",
}


def document_type(path: Column) -> Column:
    """Type by the compound suffix, else the last extension, else other."""
    low = F.lower(path)
    out = F.lit("other")
    for ext, kind in sorted(TYPES.items(), key=lambda x: x[0].count(".")):
        out = F.when(low.endswith("." + ext), kind).otherwise(out)
    return out


def decoded(raw: bytes) -> tuple[str, str]:
    """Text and encoding: by byte order mark, else UTF-8, else Windows-1252 with every byte."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace"), name
    try:
        return raw.decode(), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace"), "windows-1252"


def _xml_text(raw: bytes) -> str:
    text = re.sub(r"</(?:w:p|a:p|text:p|text:h|p|div|h[1-6]|li|tr)>", "\n", raw.decode("utf-8", "replace"))
    text = re.sub(r"<[^>]+>", "", text)
    return re.sub(r"\n{3,}", "\n\n", _entities(text)).strip()


def _entities(text: str) -> str:
    import html

    return html.unescape(text)


def _zipped(raw: bytes, wanted: str) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.search(wanted, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        return "\n\n".join(filter(None, (_xml_text(z.read(n)) for n in names)))


def _rtf(raw: bytes) -> str:
    text = re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), raw.decode("latin-1"))
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\par[d]?\b ?", "\n", text)
    return re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text).strip()


def _notebook(raw: bytes) -> str:
    cells = json.loads(raw).get("cells", [])
    return "\n\n".join("".join(c.get("source", [])) for c in cells)


def _table(raw: bytes, sep: str) -> str:
    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(decoded(raw)[0]), delimiter=sep))


#: Extension -> function from bytes to text. Others are decoded as text; pdf, mobi, chm and iWork need libraries that are not here.
READERS = {
    "docx": lambda b: _zipped(b, r"^word/document\.xml$"),
    "pptx": lambda b: _zipped(b, r"^ppt/slides/slide\d+\.xml$"),
    "odt": lambda b: _zipped(b, r"^content\.xml$"),
    "ods": lambda b: _zipped(b, r"^content\.xml$"),
    "odp": lambda b: _zipped(b, r"^content\.xml$"),
    "epub": lambda b: _zipped(b, r"\.x?html?$"),
    "xlsx": lambda b: _zipped(b, r"^xl/(?:sharedStrings|worksheets/sheet\d+)\.xml$"),
    "rtf": _rtf,
    "ipynb": _notebook,
    "csv": lambda b: _table(b, ","),
    "tsv": lambda b: _table(b, "\t"),
    "html": _xml_text,
    "htm": _xml_text,
}
CLOSED = {"pdf", "mobi", "chm", "pages", "numbers", "key"}


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, text, encoding, error of each file below `path`. A file that cannot be read has a null text and says why."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def texts(batches):
        for pdf in batches:
            out = []
            for p, b in zip(pdf["path"], pdf["content"], strict=True):
                ext = p.rsplit(".", 1)[-1].lower()
                try:
                    if ext in CLOSED:
                        raise ValueError(f"no reader for .{ext} here")
                    out.append((READERS[ext](b), "binary", None) if ext in READERS else (*decoded(b), None))
                except Exception as e:  # one bad file must not end the job
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            yield pdf[["path"]].assign(text=[o[0] for o in out], encoding=[o[1] for o in out], error=[o[2] for o in out])

    return raw.mapInPandas(texts, "path string, text string, encoding string, error string")


def export_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def import_checked(spark: SparkSession, path: str, source: DataFrame) -> DataFrame:
    """The exported table, if it holds the rows of `source`, by their number and the sum of their hashes; else ValueError."""
    out = spark.read.parquet(path)
    whole = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in source.columns]).cast("decimal(38,0)"))).first())
    if (a := whole(out)) != (b := whole(source)):
        raise ValueError(f"{a[0]} rows were exported of {b[0]}, or other ones")
    return out
