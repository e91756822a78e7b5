"""Text projections: byte truncation, embedding texts, rerank documents, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of texts, keys and marks of sensitive details.
DOCSTRING, SIGNATURE, ALIAS, CONTENT, COMPACT, RERANK, DETAIL, TOKEN = 512, 512, 256, 2048, 1024, 4096, 240, 96
SENSITIVE_KEYS = ("path", "repo_path", "file_path", "query", "content", "metadata", "embedding")
SENSITIVE_PARTS = ("/Users/", "/Volumes/", "\\")


def cut_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters with no more than `limit` UTF-8 bytes.

    Of the first `limit` bytes, what belongs to a character that goes on beyond them is dropped: that is decided by the
    byte after the cut, which continues a character if its upper bits are 10.
    """
    raw = F.encode(text, "UTF-8")
    inside = lambda k: (F.conv(F.hex(F.substring(raw, k + 1, 1)), 16, 10).cast("int").bitwiseAND(0xC0) == 0x80)
    end = F.lit(limit)
    for back in range(3, 0, -1):
        whole = F.lit(True)
        for k in range(back):
            whole = whole & inside(limit - k)
        end = F.when(whole & (F.lit(back) <= limit), F.least(end, F.lit(limit - back))).otherwise(end)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(raw, F.lit(1), end).cast("string"))


def embed_text(kind: Column, name: Column, qualified_name: Column, signature: Column, docstring: Column, raw_text: Column) -> Column:
    """What a node is embedded by."""
    doc = F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit(": "), F.substring(docstring, 1, DOCSTRING))).otherwise("")
    sign = cut_bytes(F.coalesce(signature, F.lit("")), SIGNATURE)
    return (
        F.when(kind == "file", F.concat(F.lit("file: "), qualified_name, doc))
        .when(kind == "class", F.concat(F.lit("class "), name, doc))
        .when(kind.isin("function", "method"), F.concat(kind, F.lit(" "), qualified_name, F.lit(" "), sign, doc))
        .when(kind.isin("variable", "constant"), F.concat(kind, F.lit(" "), qualified_name, F.lit(": "), sign))
        .when(kind == "import", F.concat(F.lit("import "), name))
        .when(kind == "type_alias", F.concat(F.lit("type "), name, F.lit(": "), F.substring(raw_text, 1, ALIAS)))
        .otherwise(F.concat(kind, F.lit(" "), name))
    )


def rerank_document(kind: Column, name: Column, qualified_name: Column, signature: Column, file_path: Column, content: Column) -> Column:
    """A node as a reranker reads it: one line of what isn't empty, then its content."""
    full = lambda c: F.nullif(c, F.lit(""))
    line = F.concat_ws(" ", full(kind), F.coalesce(full(qualified_name), full(name)), full(signature), full(file_path))
    return F.substring(F.concat_ws("\n", full(line), full(F.trim(F.coalesce(content, F.lit(""))))), 1, RERANK)


def shortened(text: Column) -> Column:
    return F.when(F.octet_length(text) <= DETAIL, text).otherwise(F.concat(F.substring(text, 1, DETAIL), F.lit("...")))


def sensitive(value: Column) -> Column:
    out = F.startswith(value, F.lit("/")) | (F.octet_length(value) > TOKEN)
    for part in SENSITIVE_PARTS:
        out = out | F.contains(value, F.lit(part))
    return out


def redacted(detail: Column) -> Column:
    """A detail with the values of sensitive keys, and values that look like paths or are long, taken out."""

    def one(token: Column) -> Column:
        at = F.instr(token, "=")
        key, value = F.substring(token, F.lit(1), at - 1), F.substring(token, at + 1, F.length(token))
        named = F.when(key.isin(*SENSITIVE_KEYS) | sensitive(value), F.concat(key, F.lit("=<redacted>"))).otherwise(F.concat(key, F.lit("="), shortened(value)))
        return F.when(at > 0, named).otherwise(F.when(~sensitive(token), shortened(token)))

    tokens = F.filter(F.split(F.trim(detail), r"\s+"), lambda t: t != "")
    return shortened(F.array_join(F.transform(tokens, one), " "))
