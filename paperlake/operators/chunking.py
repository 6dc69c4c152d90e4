"""Texts cut into chunks, sections and sentences, and put together again.

Defined results: null and blank texts give no chunks; chunk numbers count
from 0; repeated rows give repeated chunks.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from paperlake.functions.text import words

# Header lines of sections, and of those with references only.
SECTION = (
    r"(?i)^\s*(?:(?:\d+|[IVXLCDM]+)(?:\.\d+)*\s*[-.)]?\s*)?"
    r"(?:abstract|introduction|background|method(?:s|ology)?|materials\s*(?:&|and)\s*methods|results?(?:\s+and\s+discussion)?"
    r"|discussion|related\s+work|conclusions?|experimental|references?|bibliograph(?:y|ies)|works\s+cited|literature\s+cited"
    r"|acknowledge?ments?|funding|author\s+contributions?|conflicts?\s+of\s+interest|ethics|supplementary(?:\s+material)?|appendix)\s*:?\s*$"
)
REFERENCES = r"(?i)^\s*(?:(?:\d+|[IVXLCDM]+)(?:\.\d+)*\s*[-.)]?\s*)?(?:references?|bibliograph(?:y|ies)|works\s+cited|literature\s+cited)\s*:?\s*$"


def word_windows(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, chunk_index, chunk: windows of ``size`` words that start every ``size - overlap`` words.

    The last window may lie inside the one before it.
    """
    step = max(1, size - overlap)
    w = docs.select(F.col(key), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    at = w.select(key, "_w", F.posexplode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))).alias("chunk_index", "_s"))
    return at.select(key, "chunk_index", F.array_join(F.slice("_w", F.col("_s") + 1, F.lit(size)), " ").alias("chunk"))


def proportional(docs: DataFrame, key: str, text: str, most: int, overlap: int = 0) -> DataFrame:
    """key, chunk_index, chunk: spans of ``most`` words mapped to characters by their share of the text."""
    step = max(1, most - overlap)
    n, chars = F.size("_w"), F.length("_t")
    w = docs.select(F.col(key), F.col(text).alias("_t"), words(F.col(text)).alias("_w")).where(n > 0)
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: (s == 0) | (s - step + most < n))
    at = w.select(key, "_t", n.alias("_n"), F.posexplode(starts).alias("_i", "_s"))
    cs = F.floor(F.col("_s") / F.col("_n") * chars).cast("int")
    ce = F.floor(F.least(F.col("_s") + most, F.col("_n")) / F.col("_n") * chars).cast("int")
    cut = at.select(key, "_i", F.regexp_replace(F.col("_t").substr(cs + 1, ce - cs), r"^\s+|\s+$", "").alias("chunk"))
    order = Window.partitionBy(key).orderBy("_i")
    return cut.where("chunk <> ''").select(key, (F.row_number().over(order) - 1).alias("chunk_index"), "chunk")


def untrimmed(chunks: DataFrame, key: str, overlap: int, index: str = "chunk_index", text: str = "chunk") -> DataFrame:
    """``chunks`` with ``trimmed``: without the words that begin it and also begin the previous chunk's tail.

    The longest such run of at most ``overlap`` words is removed.
    """
    w = Window.partitionBy(key).orderBy(index)
    tail = F.slice("_p", F.greatest(F.lit(1), F.size("_p") - overlap + 1), F.lit(overlap))
    both = chunks.withColumn("_c", words(F.col(text))).withColumn("_p", F.lag(words(F.col(text))).over(w)).withColumn("_tail", tail)
    lengths = F.sequence(F.least(F.size("_tail"), F.size("_c")), F.lit(1), F.lit(-1))
    hit = F.filter(lengths, lambda m: F.slice("_tail", F.lit(1), m) == F.slice("_c", F.lit(1), m))
    cut = F.when(F.least(F.size("_tail"), F.size("_c")) > 0, F.try_element_at(hit, F.lit(1)))
    kept = F.when(cut.isNotNull(), F.array_join(F.slice("_c", cut + 1, F.greatest(F.size("_c"), F.lit(1))), " ")).otherwise(F.col(text))
    return both.withColumn("trimmed", kept).drop("_c", "_p", "_tail")


def joined(chunks: DataFrame, key: str, overlap: int) -> DataFrame:
    """key, full_text: the chunks of each key without overlaps, with a space between."""
    parts = untrimmed(chunks, key, overlap)
    return parts.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "trimmed"))), lambda s: s["trimmed"]), " ").alias("full_text")
    )


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_index, section, content: text between header lines, reference lists and blank sections dropped.

    Lines before the first header are section ``_full``. The header may be
    numbered. A text is one row, so its lines are one bounded partition.
    """
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("_i", "_l"))
    header = F.trim(F.regexp_replace("_l", r"^\s+|\s+$", "")).rlike(SECTION)
    w = Window.partitionBy(key).orderBy("_i")
    marked = lines.withColumn("_h", header).withColumn("_no", F.sum(F.col("_h").cast("int")).over(w))
    parts = marked.groupBy(key, "_no").agg(
        F.max(F.when(F.col("_h"), F.regexp_replace("_l", r"^\s+|\s+$", ""))).alias("section"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("_i", "_l")))), lambda s: s["_l"]), "\n"
        ).alias("content"),
    )
    content = F.regexp_replace("content", r"^\s+|\s+$", "")
    kept = parts.select(key, "_no", F.coalesce("section", F.lit("_full")).alias("section"), content.alias("content"))
    kept = kept.where((F.col("content") != "") & ~F.col("section").rlike(REFERENCES))
    return kept.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_no")) - 1).alias("section_index"), "section", "content")


def sentence_list(text: str) -> list[str]:
    """Sentences of a text; fragments under 40 characters are joined in pairs."""
    out: list[str] = []
    held: list[str] = []
    for line in re.split(r"\r\n|\r|\n", text):
        for s in re.split(r"(?<=[.!?])\s+", line.strip()):
            s = s.strip()
            if not s:
                continue
            if len(s) < 40:
                held.append(s)
                if len(held) > 1:
                    out.append(" ".join(held))
                    held = []
                continue
            if held:
                out.append(" ".join(held))
                held = []
            out.append(s)
    return out + ([" ".join(held)] if held else [])


@F.pandas_udf(ArrayType(StringType()))
def _sentences(s: pd.Series) -> pd.Series:
    return s.map(lambda t: sentence_list(t) if t else [])


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence_index, sentence."""
    return docs.select(F.col(key), F.posexplode(_sentences(F.col(text))).alias("sentence_index", "sentence"))


def paragraphs(docs: DataFrame, key: str, text: str, most: int = 1000, carry: int = 2) -> DataFrame:
    """key, chunk_index, chunk: whole paragraphs up to ``most`` characters, the last ``carry`` repeated in the next chunk."""
    paras = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"))

    def fold(acc: Column, p: Column) -> Column:
        held = acc["held"]
        size = F.aggregate(held, F.lit(0), lambda n, x: n + F.length(x) + 2)
        full = (F.size(held) > 0) & (size + F.length(p) > most)
        rest = F.slice(held, -F.least(F.lit(carry), F.size(held)), F.lit(carry))
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.array_join(held, "\n\n"))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array_append(rest, p)).otherwise(F.array_append(held, p)).alias("held"),
        )

    done = F.aggregate(
        paras, zero, fold, lambda a: F.when(F.size(a["held"]) > 0, F.array_append(a["done"], F.array_join(a["held"], "\n\n"))).otherwise(a["done"])
    )
    return docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(done).alias("chunk_index", "chunk"))


def hashed_vectors(sents: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: the offline stand-in for an embedding model."""
    import zlib

    out = np.zeros((len(sents), dim))
    for i, s in enumerate(sents):
        for w in re.findall(r"\w+", s.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def semantic_list(text: str, most: int, least: int, threshold: float, overlap: int, vectors=hashed_vectors) -> list[str]:
    """Runs of sentences that stay close to their running mean vector, between ``least`` and ``most`` words."""
    sents = sentence_list(text)
    if not sents:
        return []
    vecs, size = vectors(sents), [len(s.split()) for s in sents]
    chunks: list[str] = []
    cur: list[int] = []
    mean = None

    def close() -> list[int]:
        chunks.append(" ".join(sents[i] for i in cur).strip())
        back: list[int] = []
        while overlap > 0 and len(back) < len(cur) and sum(size[i] for i in back) < overlap:
            back.insert(0, cur[-1 - len(back)])
        return back

    for i, v in enumerate(vecs):
        n = sum(size[k] for k in cur)
        if cur and n >= least:
            scale = np.linalg.norm(mean) * np.linalg.norm(v)
            far = (float(mean @ v / scale) if scale else 0.0) < threshold
            if far or n + size[i] > most:
                close()
                cur, mean = [i], v
                continue
        mean = v if not cur else (mean * len(cur) + v) / (len(cur) + 1)
        cur.append(i)
        if sum(size[k] for k in cur) > most:
            cur = close()
            mean = vecs[cur].mean(axis=0) if cur else None
    if cur:
        close()
    return [c for c in chunks if c]


def semantic(docs: DataFrame, key: str, text: str, most: int = 400, least: int = 60, threshold: float = 0.2, overlap: int = 0) -> DataFrame:
    """key, chunk_index, chunk by ``semantic_list``; a fold over one text at a time, in Arrow batches."""

    @F.pandas_udf(ArrayType(StringType()))
    def runs(s: pd.Series) -> pd.Series:
        return s.map(lambda t: semantic_list(t, most, least, threshold, overlap) if t else [])

    return docs.select(F.col(key), F.posexplode(runs(F.col(text))).alias("chunk_index", "chunk"))


def repaired_spans(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Spans clipped to the text, put in order, overlaps cut off and gaps filled, so that they cover it once."""
    fixed = sorted((max(0, min(s, e)), min(length, max(s, e))) for s, e in spans)
    out: list[tuple[int, int]] = []
    at = 0
    for s, e in fixed:
        if e <= at:
            continue
        if s > at:
            out.append((at, s))
        out.append((max(s, at), e))
        at = e
    if at < length:
        out.append((at, length))
    return out


def sized_spans(text: str, spans: list[tuple[int, int]], least: int, most: int) -> list[str]:
    """Text of the spans, short ones joined to the one before, long ones cut at sentences, else in halves."""
    parts: list[str] = []
    for s, e in spans:
        piece = text[s:e]
        if parts and len(parts[-1].split()) < least:
            parts[-1] += piece
        else:
            parts.append(piece)

    def halved(p: str) -> list[str]:
        w = p.split()
        if len(w) <= most:
            return [p]
        sents = sentence_list(p)
        if len(sents) > 1:
            out: list[str] = []
            for x in sents:
                if out and len(out[-1].split()) + len(x.split()) <= most:
                    out[-1] += " " + x
                else:
                    out.append(x)
            return [y for x in out for y in (halved(x) if len(x.split()) > most else [x])]
        mid = len(w) // 2
        return halved(" ".join(w[:mid])) + halved(" ".join(w[mid:]))

    return [q.strip() for p in parts for q in halved(p) if q.strip()]


def metadata_chunk(papers: DataFrame) -> DataFrame:
    """paper_id, chunk_index 0, chunk: title, authors, year, DOI and abstract of each paper."""
    line = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(name + ": "), c.cast("string")))
    text = F.concat_ws(
        "\n", line("Title", F.col("title")), line("Authors", F.col("authors")), line("Year", F.col("year")), line("DOI", F.col("doi")),
        line("Abstract", F.col("abstract")),
    )
    return papers.select("paper_id", F.lit(0).alias("chunk_index"), text.alias("chunk"))


def pieces(docs: DataFrame, key: str, text: str, chars: int = 100) -> DataFrame:
    """key, seq, delta: a text in pieces of ``chars`` characters, as it is streamed to a client."""
    t = docs.where(F.length(text) > 0)
    return t.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chars).cast("int")),
                    lambda i: F.col(text).substr(i * chars + 1, F.lit(chars)))).alias("seq", "delta"))


def least_tokens(most: int) -> int:
    """Smallest chunk by default: two fifths of the largest, at least 200."""
    return max(int(most * 0.4), 200)


def chunker(method: str, model=None):
    """The chunker of a method; unknown methods, and ``agentic`` without a model, are cut by words."""
    if method == "agentic" and model is not None:
        return partial(agentic, model=model)
    return {"token": word_windows, "section_aware": in_sections, "semantic": semantic}.get(method, word_windows)


def adapted(size: int, overlap: int) -> tuple[int, int]:
    """Words for a chunk size and overlap given in tokens: three quarters of each."""
    return int(size * 0.75), int(overlap * 0.75)


def encoder(folder: str = "/opt/tokenizers", name: str = "byte_bpe_50k"):
    """Text to tokens by the first tokenizer there is: a rank file, a tokenizer file, else white space."""
    import os

    try:
        import base64

        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in f if x.strip())}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    except (ImportError, OSError):
        pass
    try:
        from tokenizers import Tokenizer

        file = os.path.join(folder, f"{name}.json")
        if os.path.exists(file):
            made = Tokenizer.from_file(file)
            return lambda t: made.encode(t, add_special_tokens=False).ids
    except ImportError:
        pass
    return str.split


def span_request(window: str, most: int, least: int) -> str:
    """What a model is asked about one window."""
    return (
        f'Divide the text below into passages that make sense alone. Reply with JSON only: {{"spans": [{{"start": 0, "end": 10}}]}}.\n'
        f"Offsets count characters from 0 to {len(window)}; spans follow each other without gaps or overlaps, have about {most} and at least {least} words, "
        f"and end where a paragraph or sentence does.\n\n{window}"
    )


def spans_of(answer: str | None) -> list[tuple[int, int]]:
    """Spans in a model's answer; none if it holds no such JSON."""
    import json

    m = re.search(r"(?s)\{.*\}", answer or "")
    try:
        return [(int(s["start"]), int(s["end"])) for s in json.loads(m[0])["spans"]] if m else []
    except (ValueError, KeyError, TypeError):
        return []


def agentic(docs: DataFrame, key: str, text: str, most: int = 400, overlap: int = 0, least: int = 60, model=None, window: int = 8000) -> DataFrame:
    """key, chunk_index, chunk: passages a model finds in windows of ``window`` characters.

    Spans are clipped, ordered and completed to cover the window; a window
    whose answer is no use is cut by words. ``overlap`` words of a passage
    begin the next one.
    """
    from paperlake.connectors import completed

    n = F.ceil(F.length(text) / window).cast("int")
    wide = docs.where(F.trim(F.col(text)) != "").select(F.col(key).alias("_key"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col(text).substr(i * window + 1, F.lit(window)))).alias("_w", "_t"))

    @F.pandas_udf(StringType())
    def request(t: pd.Series) -> pd.Series:
        return t.map(lambda x: span_request(x, most, least))

    @F.pandas_udf(ArrayType(StringType()))
    def passages(t: pd.Series, a: pd.Series) -> pd.Series:
        def one(x: str, answer: str | None) -> list[str]:
            spans = spans_of(answer)
            if not spans:
                w = x.split()
                return [" ".join(w[i : i + most]) for i in range(0, len(w), most)]
            return sized_spans(x, repaired_spans(spans, len(x)), least, most)

        return pd.Series([one(x, y) for x, y in zip(t, a)])

    said = completed(wide.withColumn("_p", request("_t")), "_p", model, "_a")
    flat = said.select("_key", "_w", F.posexplode(passages("_t", "_a")).alias("_i", "chunk"))
    w = Window.partitionBy("_key").orderBy("_w", "_i")
    before = F.lag("chunk").over(w)
    tail = F.array_join(F.slice(words(before), F.greatest(F.lit(1), F.size(words(before)) - overlap + 1), F.lit(max(overlap, 1))), " ")
    chunk = F.when(before.isNotNull() & F.lit(overlap > 0), F.concat(tail, F.lit(" "), "chunk")).otherwise(F.col("chunk"))
    return flat.select(F.col("_key").alias(key), (F.row_number().over(w) - 1).alias("chunk_index"), chunk.alias("chunk"))


def in_sections(docs: DataFrame, key: str, text: str, most: int, overlap: int = 0) -> DataFrame:
    """key, section_index, section, chunk_index, chunk: each section cut by ``proportional``."""
    s = sections(docs, key, text).withColumn("_k", F.struct(key, "section_index", "section"))
    return proportional(s, "_k", "content", most, overlap).select(
        F.col(f"_k.{key}").alias(key), F.col("_k.section_index").alias("section_index"), F.col("_k.section").alias("section"), "chunk_index", "chunk"
    )
