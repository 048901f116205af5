"""Context assembly: ranked hits into a budget of tokens, bytes and documents."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Budget:
    max_tokens: int
    max_bytes: int = 1 << 30
    max_documents: int = 1 << 30


@dataclass
class Context:
    blocks: list[tuple] = field(default_factory=list)  # citation, key, text, tokens, bytes, truncated
    documents: set = field(default_factory=set)
    tokens: int = 0
    bytes: int = 0
    omitted: int = 0
    truncated: int = 0

    @property
    def text(self) -> str:
        return "\n\n".join(f"[{b[0]}]\n{b[2]}" for b in self.blocks)


def cut(text: str, tokens: int, size: int) -> tuple[str, int, bool]:
    """The longest head of whole characters within both budgets, without white space at its end."""
    words = WORD.finditer(text)
    end = len(text)
    for n, m in enumerate(words):
        if n == tokens:
            end = m.start()
            break
    head = text[:end]
    if len(head.encode()) > size:
        head = head.encode()[:size].decode("utf-8", "ignore")
    return head.rstrip(), len(WORD.findall(head)), len(head) < len(text)


def assemble(hits: list[tuple[object, object, str | None]], budget: Budget) -> Context:
    """`hits` are (key, document, text) in rank order; what doesn't fit is counted as omitted."""
    out = Context()
    for key, document, text in hits:
        new = document not in out.documents
        room = budget.max_tokens - out.tokens, budget.max_bytes - out.bytes
        if not text or (new and len(out.documents) >= budget.max_documents) or min(room) <= 0:
            out.omitted += 1
            continue
        head, n, short = cut(text, *room)
        if not head:
            out.omitted += 1
            continue
        size = len(head.encode())
        out.documents.add(document)
        out.tokens, out.bytes, out.truncated = out.tokens + n, out.bytes + size, out.truncated + short
        out.blocks.append((f"ctx-{len(out.blocks) + 1}", key, head, n, size, short))
    return out


def assemble_groups(hits: DataFrame, group: str, rank: str, key: str, document: str, text: str, budget: Budget) -> DataFrame:
    """A context for each group (a query, a conversation): the blocks with their citations."""
    import pandas as pd

    schema = T.StructType([T.StructField(group, hits.schema[group].dataType), T.StructField("citation_id", T.StringType()), T.StructField(key, hits.schema[key].dataType), T.StructField("text", T.StringType()), T.StructField("token_count", T.LongType()), T.StructField("byte_count", T.LongType()), T.StructField("truncated", T.BooleanType())])

    def run(name, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([rank, "__k"])
        built = assemble(list(zip(rows["__k"], rows["__d"], rows["__t"], strict=True)), budget)
        return pd.DataFrame([(name[0], *b) for b in built.blocks], columns=schema.names)

    from pyspark.sql import functions as F

    slim = hits.select(group, rank, F.col(key).alias("__k"), F.col(document).alias("__d"), F.col(text).alias("__t"))
    return slim.groupBy(group).applyInPandas(run, schema)
