"""How messages, attachments and embeds read in a chunk, and what they cost in tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What kind of file an extension stands for.
LABELS = {
    "Image": "png jpg jpeg gif webp bmp svg",
    "Video": "mp4 mov webm avi mkv",
    "Audio": "mp3 wav ogg flac m4a",
    "Document": "pdf doc docx txt rtf odt",
    "Code": "py js ts go rs java c cpp h hpp cs rb php swift kt scala sh bash zsh ps1 sql html css scss less json yaml yml xml toml ini md rst",
    "Archive": "zip tar gz bz2 xz 7z rar",
}
NAME_LENGTH, DESCRIPTION_TOKENS, VALUE_TOKENS, FIELDS = 100, 60, 30, 5

Counter = Callable[[Column], Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_tokens(text) -> Column:
    """The default counter: a token for every four characters begun."""
    return F.floor((F.coalesce(F.length(_c(text)), F.lit(0)) + 3) / 4).cast("bigint")


#: Texts of which a worker remembers what a tokenizer said of them (a fixed value).
REMEMBERED = 16_384


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    return loaded


@lru_cache(maxsize=REMEMBERED)
def _tokens(path: str, text: str) -> int:
    return len(_tokenizer(path).encode(text, add_special_tokens=False).ids) if text else 0


def tokenizer_counter(path: str) -> Counter:
    """A counter that asks a tokenizer file; a worker loads it once and remembers what it said of texts that come again."""

    def counted(text: pd.Series) -> pd.Series:
        return pd.Series([_tokens(path, x or "") for x in text], dtype="int64")

    return F.pandas_udf(counted, T.LongType())


def tokenizer_truncator(path: str, n: int) -> Counter:
    """A column function that cuts a text after its first ``n`` tokens and says so by dots; shorter ones and nulls stay."""

    def cut(text: pd.Series) -> pd.Series:
        out = []
        for x in text:
            ids = _tokenizer(path).encode(x, add_special_tokens=False).ids if x else []
            out.append(x if len(ids) <= n else _tokenizer(path).decode(ids[:n], skip_special_tokens=True) + "...")
        return pd.Series(out, dtype=object)

    return F.pandas_udf(cut, T.StringType())


def truncate_tokens(text, n: int) -> Column:
    """Under the default counter: at most n tokens, then dots."""
    return F.when(count_tokens(text) > n, F.concat(F.substring(_c(text), 1, 4 * n), F.lit("..."))).otherwise(_c(text))


def _last_dot(name: Column) -> Column:
    """Where the last dot is, from 0; -1 without one."""
    return F.when(F.instr(name, ".") > 0, F.length(name) - F.instr(F.reverse(name), ".")).otherwise(-1)


def short_name(filename) -> Column:
    """At most NAME_LENGTH characters; an extension, if the name does not begin with it, is kept."""
    name = _c(filename)
    dot = _last_dot(name)
    extension = F.substr(name, dot + 1)
    base = NAME_LENGTH - 3 - F.length(extension)
    # A longer extension counts from the end of the name, as slicing by a negative number does.
    kept = F.when(base >= 0, base).otherwise(F.greatest(F.length(name) + base, F.lit(0)))
    with_extension = F.concat(F.substr(name, F.lit(1), kept.cast("int")), F.lit("..."), extension)
    bare = F.concat(F.substring(name, 1, NAME_LENGTH - 3), F.lit("..."))
    return F.when(F.length(name) <= NAME_LENGTH, name).when(dot > 0, with_extension).otherwise(bare)


def label(filename) -> Column:
    name = _c(filename)
    known = F.create_map(*[F.lit(x) for kind, names in LABELS.items() for e in names.split() for x in (e, kind)])
    extension = F.lower(F.substring_index(name, ".", -1))
    return F.when(_last_dot(name) >= 0, F.coalesce(F.try_element_at(known, extension), F.lit("File"))).otherwise(F.lit("File"))


def attachment_line(filename) -> Column:
    short = short_name(filename)
    return F.concat(F.lit("["), label(short), F.lit(": "), short, F.lit("]"))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def embed_line(embed) -> Column:
    """One line for an embed, empty for one without content."""
    e = _c(embed)
    fields = F.filter(F.slice(e["fields"], 1, FIELDS), lambda f: _filled(f["name"]).isNotNull() & _filled(f["value"]).isNotNull())
    values = F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), truncate_tokens(f["value"], VALUE_TOKENS)))
    title, author, description, footer = (_filled(x) for x in (e["title"], e["author"]["name"], e["description"], e["footer"]["text"]))
    parts = F.array_compact(
        F.concat(
            F.array(F.concat(F.lit('"'), title, F.lit('"')), F.concat(F.lit("by "), author), truncate_tokens(description, DESCRIPTION_TOKENS)),
            F.coalesce(values, F.array().cast("array<string>")),
            F.array(footer),
        )
    )
    return F.when(F.size(parts) > 0, F.concat(F.lit("[Embed: "), F.array_join(parts, " - "), F.lit("]"))).otherwise(F.lit(""))


def message_text(username, author_id, created_at, content, filenames=None, embeds=None) -> Column:
    """Header with author and day, content, attachments and embeds, a line each; empty ones are left out."""
    none = F.array().cast("array<string>")
    header = F.concat(F.lit("["), F.coalesce(_filled(_c(username)), _c(author_id).cast("string")), F.lit("] "), F.date_format(_c(created_at), "yyyy-MM-dd"))
    files = F.transform(_c(filenames), attachment_line) if filenames is not None else none
    lines = F.filter(F.transform(_c(embeds), embed_line), lambda x: x != "") if embeds is not None else none
    every = F.concat(F.array(header, _filled(_c(content))), F.coalesce(files, none), F.coalesce(lines, none))
    return F.array_join(F.array_compact(every), "\n")


def message_cost(text, counter: Counter = count_tokens) -> Column:
    """Tokens of a rendered message and of the blank line after it."""
    return counter(_c(text)) + F.lit(2)


def chunk_text(lines, reply_chain: bool = False) -> Column:
    """Rendered messages in order, a blank line between them; replies in a chain are marked."""
    marked = F.transform(_c(lines), lambda x, i: F.when(i > 0, F.concat(F.lit("↳ "), x)).otherwise(x)) if reply_chain else _c(lines)
    return F.array_join(marked, "\n\n")
