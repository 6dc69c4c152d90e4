"""PDF files to text where a PDF library is installed; without one every row has a null text and an error.

Pages are joined by a blank line and kept as sections ``page_<n>``. Text of
200 characters or fewer counts as none.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def page_texts(content: bytes) -> list[str]:
    """Texts of a file's pages by the first library that is there."""
    try:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return ["\n".join(b[4].strip() for b in page.get_text("blocks", sort=True) if b[6] == 0) for page in doc]
    except ImportError:
        pass
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    with pdfplumber.open(io.BytesIO(content)) as doc:
        return [page.extract_text(x_tolerance=1.5, y_tolerance=1.5) or "" for page in doc.pages]


def read(df: DataFrame, key: str, content: str, pages=page_texts) -> DataFrame:
    """key, text, pages (array), error of binary files; text in UTF-8 passes as it is."""

    def run(batches):
        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    if c is None or len(c) < 1000:
                        raise ValueError("fewer than 1000 bytes")
                    got = pages(c) if c[:4] == b"%PDF" else [c.decode("utf-8")]
                    text = "\n\n".join(p for p in got if p.strip())
                    out.append((k, text, got, None) if len(text) > 200 else (k, None, got, "too little text"))
                except Exception as e:
                    out.append((k, None, None, str(e) or type(e).__name__))
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [key, "text", "pages", "error"])

    return df.selectExpr(f"cast({key} as string) {key}", content).mapInArrow(run, f"{key} string, text string, pages array<string>, error string")


def scan(spark: SparkSession, path: str) -> DataFrame:
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path), "path", "content")
