"""Markdown and converted documents: frontmatter, flattening of blocks, table and list clean-up, format routing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_heading, clean_title, extension, strip

# The extensions of each format.
FORMATS = {
    "md": (".md", ".markdown"),
    "docx": (".docx", ".docm"), "doc": (".doc",), "pptx": (".ppt", ".pptx", ".pptm", ".pps", ".ppsx", ".ppsm", ".pot"), "xlsx": (".xls", ".xlsx", ".xlsm", ".xlsb"),
    "odt": (".odt",), "ods": (".ods",), "odp": (".odp",), "rtf": (".rtf",), "epub": (".epub",), "csv": (".csv",), "pdf": (".pdf",),
}
# Keys that are never taken over.
UNSAFE_KEYS = ("__proto__", "constructor", "prototype")


def format_of(path: Column, formats: Sequence[str] = ("md",)) -> Column:
    """The first of the wanted formats that claims the path's extension; null if none."""
    if unknown := [f for f in formats if f not in FORMATS]:
        raise ValueError(f"unknown format: {', '.join(unknown)}")
    out = F.lit(None).cast("string")
    for name in reversed(formats):
        out = F.when(extension(path).isin(*FORMATS[name]), F.lit(name)).otherwise(out)
    return out


def split_frontmatter(text: Column) -> tuple[Column, Column]:
    """(block, body): the leading ``---`` block, empty without one, and what follows."""
    pattern = r"\A\uFEFF?---[^\S\n]*\n(?s:(.*?\n)??)---[^\S\n]*(?:\n|\z)"
    return F.regexp_extract(text, pattern, 1), F.regexp_replace(text, pattern, "")


def parse_yaml(block: str) -> dict:
    """The YAML that frontmatter uses: nested mappings and lists, quoted and block scalars, inline lists and mappings."""
    lines = block.expandtabs(4).splitlines()
    at = _content(lines, 0)
    if at == len(lines):
        return {}
    out, at = _node(lines, at, _indent(lines[at]))
    if at < len(lines):
        raise ValueError(f"frontmatter line {at + 1}: unexpected indentation")
    if not isinstance(out, dict):
        raise ValueError(f"frontmatter line {at}: not a key and a value")
    return {k: v for k, v in out.items() if k not in UNSAFE_KEYS}


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _content(lines: list[str], at: int) -> int:
    """The next line that is neither blank nor a comment."""
    while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("#")):
        at += 1
    return at


def _node(lines: list[str], at: int, indent: int):
    """(value, next line) of the mapping or list whose entries stand at ``indent``."""
    is_list = bool(re.match(r" *-(?: |$)", lines[at]))
    out: dict | list = [] if is_list else {}
    while at < len(lines) and _indent(lines[at]) == indent and bool(re.match(r" *-(?: |$)", lines[at])) == is_list:
        text = lines[at].strip()
        if is_list:
            rest = text[1:].lstrip()
            if re.match(_KEY, rest) and rest[0] not in "[{":  # a mapping that starts beside the dash
                lines = [*lines[:at], " " * (indent + len(text) - len(rest)) + rest, *lines[at + 1 :]]
                value, at = _node(lines, at, indent + len(text) - len(rest))
            else:
                value, at = _value(lines, at, indent, rest)
            out.append(value)
        else:
            found = re.match(_KEY, text)
            if not found:
                raise ValueError(f"frontmatter line {at + 1}: not a key and a value")
            key = found[1].strip()
            value, at = _value(lines, at, indent, (found[2] or "").strip())
            out[key[1:-1] if len(key) > 1 and key[0] in "'\"" and key[-1] == key[0] else key] = value
        at = _content(lines, at)
    if at < len(lines) and _indent(lines[at]) > indent:
        raise ValueError(f"frontmatter line {at + 1}: unexpected indentation")
    return out, at


_KEY = r"(\"[^\"]*\"|'[^']*'|[^:\s\"'][^:]*):(?:\s+(.*))?$"


def _value(lines: list[str], at: int, indent: int, rest: str):
    """(value, next line) of an entry: beside its key or dash, or below it."""
    if mark := re.match(r"([|>])([-+]?)\s*$", rest):
        return _block_scalar(lines, at + 1, indent, mark[1], mark[2])
    if rest and not rest.startswith("#"):
        return _scalar(rest, at + 1), at + 1
    below = _content(lines, at + 1)
    if below < len(lines) and (_indent(lines[below]) > indent or (_indent(lines[below]) == indent and lines[at].strip()[0] != "-" and re.match(r" *-(?: |$)", lines[below]))):
        return _node(lines, below, _indent(lines[below]))
    return None, at + 1


def _block_scalar(lines: list[str], at: int, indent: int, mark: str, tail: str):
    """Lines as they stand (``|``), or folded into one but for blank lines (``>``); ``-`` drops the line end, ``+`` keeps all."""
    end = at
    while end < len(lines) and (not lines[end].strip() or _indent(lines[end]) > indent):
        end += 1
    own = lines[at:end]
    deep = min((_indent(x) for x in own if x.strip()), default=0)
    own = [x[deep:].rstrip() if x.strip() else "" for x in own]
    text = "\n".join(own).rstrip("\n")
    if mark == ">":
        text = re.sub(r"(?<!\n)\n(?!\n)", " ", text).replace("\n\n", "\n")
    kept = len(own) - len("\n".join(own).rstrip("\n").split("\n")) if text else 0
    return text + ("" if tail == "-" or not text else "\n" * (1 + kept) if tail == "+" else "\n"), end


def _scalar(raw: str, n: int):
    raw = re.sub(r"\s+#.*$", "", raw).strip() if not raw.strip()[:1] in "'\"" else raw.strip()
    if raw in ("", "~", "null"):
        return None
    if raw[0] in "'\"":
        if len(raw) < 2 or raw[-1] != raw[0]:
            raise ValueError(f"frontmatter line {n}: unclosed quote")
        return json.loads(raw) if raw[0] == '"' else raw[1:-1].replace("''", "'")
    if raw[0] in "[{":
        kind, close = ("list", "]") if raw[0] == "[" else ("mapping", "}")
        if raw[-1] != close:
            raise ValueError(f"frontmatter line {n}: unclosed {kind}")
        parts = [x.strip() for x in _inline_parts(raw[1:-1])]
        if kind == "list":
            return [_scalar(x, n) for x in parts if x]
        pairs = [re.match(_KEY, x if ":" in x else f"{x}:") for x in parts if x]
        if not all(pairs):
            raise ValueError(f"frontmatter line {n}: not a key and a value")
        return {m[1].strip().strip("'\""): _scalar(m[2] or "", n) for m in pairs}
    if raw in ("true", "false"):
        return raw == "true"
    if re.fullmatch(r"[-+]?\d+", raw):
        return int(raw)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?", raw):
        return float(raw)
    return raw


def _inline_parts(text: str) -> list[str]:
    """Parts between commas that stand in no quote, list or mapping."""
    out, start, depth, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and not (quote == '"' and text[i - 1] == "\\") else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def _inline(text: str) -> str:
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", text)
    text = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", text)
    text = re.sub(r"(?<!\\)`+([^`]+)`+", r"\1", text)
    text = re.sub(r"(?<!\\)(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<![\\\w])([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)


def flatten(markdown: str) -> str:
    """Plain text of Markdown blocks: headings keep their marks, code is indented, blocks are parted by blank lines, list items by line ends."""
    blocks: list[tuple[str, str]] = []
    lines, i = markdown.replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if fence := re.match(r" {0,3}(`{3,}|~{3,})", line):
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[j])), len(lines))
            body = "\n".join("    " + x if x else x for x in lines[i + 1 : end]).rstrip()
            blocks.append(("code", body))
            i = end + 1
        elif re.match(r"(?: {4}|\t)\s*\S", line) and (not blocks or blocks[-1][0] != "text" or not lines[i - 1].strip()):
            end = i
            while end < len(lines) and (not lines[end].strip() or re.match(r" {4}|\t", lines[end])):
                end += 1
            body = [re.sub(r"^(?: {4}|\t)", "", x) for x in lines[i:end]]
            blocks.append(("code", "\n".join("    " + x if x else x for x in body).rstrip()))
            i = end
        elif not line.strip():
            i += 1
        elif heading := re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
            blocks.append(("heading", f"{heading[1]} {_inline(heading[2] or '').strip()}"))
            i += 1
        elif re.match(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$", line):
            i += 1
        elif re.match(r" {0,3}>", line):
            end = i
            while end < len(lines) and lines[end].strip():
                end += 1
            blocks.append(("quote", flatten("\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:end]))))
            i = end
        elif item := re.match(r"( {0,3}(?:[-+*]|\d{1,9}[.)]))(?:\s+|$)", line):
            width, end = len(item[0]), i + 1
            while end < len(lines) and (re.match(rf" {{{min(width, len(item[1]) + 1)}}}", lines[end]) or (lines[end].strip() and lines[end - 1].strip() and not re.match(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:\s|$)|#{1,6}\s|`{3}|>", lines[end])) or (not lines[end].strip() and end + 1 < len(lines) and re.match(rf" {{{min(width, len(item[1]) + 1)}}}\S", lines[end + 1]))):
                end += 1
            body = [line[width:], *(re.sub(rf"^ {{0,{width}}}", "", x) for x in lines[i + 1 : end])]
            blocks.append(("item", flatten("\n".join(body))))
            i = end
        else:
            end = i + 1
            while end < len(lines) and lines[end].strip() and not re.match(r" {0,3}(?:#{1,6}(?:\s|$)|`{3}|~{3}|>|[-+*]\s)", lines[end]):
                if under := re.match(r" {0,3}(=+|-+)\s*$", lines[end]):
                    blocks.append(("heading", f"{'#' if under[1][0] == '=' else '##'} " + _inline(" ".join(x.strip() for x in lines[i:end])).strip()))
                    break
                end += 1
            else:
                blocks.append(("text", _inline("\n".join(x.strip() for x in lines[i:end])).strip()))
                i = end
                continue
            i = end + 1
    out, last = "", None
    for kind, text in blocks:
        if text:
            out += ("" if not out else "\n" if kind == last == "item" else "\n\n") + text
            last = kind
    return out


def parse_pages(files: DataFrame) -> DataFrame:
    """(…, frontmatter, plain, error) of (path, text): JSON frontmatter and plain text; a file that fails says why and has neither."""
    schema = "struct<frontmatter:string,plain:string,error:string>"

    @F.pandas_udf(schema)
    def parse(blocks: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for block, body in zip(blocks, bodies, strict=True):
            try:
                rows.append((json.dumps(parse_yaml(block or ""), ensure_ascii=False), flatten(body or ""), None))
            except ValueError as error:
                rows.append((None, None, str(error)))
        return pd.DataFrame(rows, columns=["frontmatter", "plain", "error"])

    block, body = split_frontmatter(F.col("text"))
    return files.withColumn("_p", parse(block, body)).select(*files.columns, "_p.*")


def table_cells(row: Column) -> Column:
    """Cells of a table row between its outer pipes; an escaped pipe belongs to its cell."""
    inner = F.substr(row, F.lit(2), F.length(row) - 2)
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: strip(F.replace(c, F.lit("\\|"), F.lit("|"))))


def neutral(text: Column) -> Column:
    """A leading ``#`` escaped, so that no cell or item reads as a heading."""
    return F.regexp_replace(text, r"^(\s*)(#{1,6}\s)", r"$1\\$2")


_FENCE = r"(?m)^[^\S\n]*(?:```|~~~)[^\n]*$"


def normal_blocks(text: Column) -> Column:
    """Converter Markdown as plain lines: fences stay, table rules and empty rows go, list and quote marks are stripped."""

    def one(line: Column) -> Column:
        bare = strip(line)
        cells = table_cells(bare)
        item = r"\A\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?"
        quote = r"\A\s*>+\s?"
        return (
            F.when(bare.rlike(r"\A\|(?:\s*:?-{3,}:?\s*\|)+\z"), F.lit(None))
            .when(bare.rlike(r"\A\|.*\|\z") & (F.length(bare) > 2), F.when(F.exists(cells, lambda c: c != ""), neutral(F.array_join(cells, " | "))))
            .when(line.rlike(item), F.nullif(neutral(strip(F.regexp_replace(line, item, ""))), F.lit("")))
            .when(line.rlike(r"\A\s*>"), F.nullif(neutral(strip(F.regexp_replace(line, quote, ""))), F.lit("")))
            .otherwise(line)
        )

    def part(segment: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, segment).otherwise(F.array_join(F.array_compact(F.transform(F.split(segment, "\n"), one)), "\n"))

    # What stands between fence lines is outside and inside of a fence in turn.
    text = F.regexp_replace(text, r"\r(?=\n|\z)", "")
    return F.array_join(F.flatten(F.zip_with(F.transform(F.split(text, _FENCE), part), F.regexp_extract_all(text, F.lit(_FENCE), F.lit(0)), lambda x, fence: F.array(x, F.coalesce(fence, F.lit(""))))), "")


def drop_repeated_headings(text: Column) -> Column:
    """Text without a heading that repeats the one before it with only blanks between."""
    # Lines that aren't blank, each with the line ends and blanks before it; what follows the last one is left.
    filled = r"(?:[^\S\n]*\n)*[^\S\n]*\S[^\n]*"
    pieces = F.regexp_extract_all(text, F.lit(filled), F.lit(0))

    def without_repeats(own: Column) -> Column:
        def kept(piece: Column, i: Column) -> Column:
            bare, before = strip(piece), strip(F.get(own, i - 1))
            repeats = bare.rlike(r"\A#{1,6}\s+") & (bare == before)
            return F.when((i > 0) & repeats, F.regexp_replace(piece, r"\n[^\n]*\z", "")).otherwise(piece)

        return F.array_join(F.transform(own, kept), "")

    tail = F.regexp_extract(text, r"(\s*)\z", 1)
    # an array of one, so that the pieces are found once and not for each of them
    return F.concat(F.transform(F.array(pieces), without_repeats)[0], tail)


def normal_markdown(text: Column) -> Column:
    squeeze = lambda t: strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return squeeze(drop_repeated_headings(squeeze(normal_blocks(text))))


def converted_pages(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """(path, plain, title, error) of (path, bytes) by a foreign converter to Markdown; a failure gives an empty page and its reason."""

    @F.pandas_udf("struct<md:string,error:string>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for one in data:
            try:
                rows.append((convert(bytes(one)), None))
            except Exception as error:  # converters are foreign code: one bad document must not stop the rest
                rows.append(("", f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["md", "error"])

    made = files.withColumn("_c", run("bytes")).select("path", normal_markdown(F.col("_c.md")).alias("plain"), "_c.error")
    return made.withColumn("title", clean_title(any_heading(F.col("plain"))))


def csv_pages(spark, path: str) -> DataFrame:
    """(path, plain) of CSV files: a line per row, cells joined by `` | ``; rows stay in file order."""
    rows = spark.read.option("header", False).csv(path).select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at"))
    cells = [c for c in rows.columns if not c.startswith("_path") and c != "_at"]
    lines = rows.select("_path", "_at", F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("")) for c in cells]).alias("line"))
    return lines.groupBy(F.col("_path").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"]), "\n").alias("plain"))
