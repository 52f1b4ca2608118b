"""One consistent form for texts that look alike (problem 8).

DuckDB runs inside the Arrow partitions: its embedded SQL maps compatibility forms, look-alikes and invisible characters
with ``replace`` and ``translate``, composes with ``nfc_normalize`` and squeezes white space with a pattern.  DuckDB has
no compatibility decomposition, so the character map of a batch is derived from the characters that occur in it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.operators.lookup import lookup
from pairforge.storage import materialize

#: Group members per salt when pairs inside one form are made.
PER_SALT = 2000
#: Replacements in one SQL expression (the parser's depth has a limit); more go into further statements.
PER_STATEMENT = 200
#: About as many characters are handed to the embedded database at once, unless one text has more.
SLICE_CHARS = 4 << 20


def invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c == "\u034f" or "\ufe00" <= c <= "\ufe0f"


def form_of(text: str | None, looks: dict[str, str]) -> str | None:
    """The form of one text, straight from its definition; the embedded SQL must give the same."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKD", "".join(c for c in text if not invisible(c)))
    if any(len(k) != 1 for k in looks):  # the longest that stands at a place is replaced
        text = re.sub("|".join(re.escape(k) for k in sorted(looks, key=len, reverse=True) if k), lambda m: looks[m[0]], text)
    else:
        text = "".join(looks.get(c, c) for c in text)
    return " ".join(unicodedata.normalize("NFC", text).split())


def target(c: str, looks: dict[str, str]) -> str:
    """What stands for one character before composition."""
    if invisible(c):
        return ""
    return "".join(" " if x.isspace() else x for x in (looks.get(x, x) for x in unicodedata.normalize("NFKD", c)))


class Former:
    """Gives forms for Arrow arrays of texts; one DuckDB connection per Python worker task."""

    def __init__(self, looks: dict[str, str]):
        import duckdb

        self.looks = looks
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        # Marks that are look-alikes could change their order against other marks, and longer look-alikes can stretch over
        # several characters of a text: such tables take the plain path.
        self.plain = any(len(k) != 1 or any(map(unicodedata.combining, k + v)) for k, v in looks.items())
        self.ascii = {c for c in looks if c < "\x7f"}
        self.known: dict[str, str] = {}

    def sql(self, chars: Iterable[str]) -> list[str] | None:
        """The expressions, to be applied one after the other, for texts with these characters; None if one replacement
        could touch another's result."""
        single, gone, several = [], [], []
        for c in chars:
            if c not in self.known:
                self.known[c] = target(c, self.looks)
            t = self.known[c]
            if t == c or t == unicodedata.normalize("NFD", c):
                continue  # composition treats it like its decomposition
            (gone if not t else single if len(t) == 1 else several).append((c, t))
        moved = {c for c, _ in single + gone + several}
        if any(x in moved or x == "\0" for _, t in single + several for x in t):
            return None
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        out = []
        for at in range(0, len(several) or 1, PER_STATEMENT):
            chain = "text"
            for c, t in several[at : at + PER_STATEMENT]:
                chain = f"replace({chain}, {quote(c)}, {quote(t)})"
            out.append(chain)
        if single or gone:
            out[-1] = f"translate({out[-1]}, {quote(''.join(c for c, _ in single + gone))}, {quote(''.join(t for _, t in single))})"
        out[-1] = f"trim(regexp_replace(nfc_normalize({out[-1]}), ' +', ' ', 'g'))"
        return out

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The forms, in the order of the texts."""
        texts = texts.cast(pa.string())
        group = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(group) - group) // SLICE_CHARS
        cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(texts)]
        return pa.concat_arrays([self.forms(texts.slice(x, y - x)) for x, y in zip(cuts, cuts[1:]) if y > x] or [texts])

    def forms(self, texts: pa.Array) -> pa.Array:
        import duckdb

        try:
            out = None if self.plain else self.embedded(texts)
        except duckdb.OutOfMemoryException:  # a text beyond the memory of the embedded database
            self.con.unregister("t")
            out = None
        return pa.array([form_of(x, self.looks) for x in texts.to_pylist()], pa.string()) if out is None else out

    def embedded(self, texts: pa.Array) -> pa.Array | None:
        """The forms by SQL; None if these texts must take the plain path."""
        self.con.register("t", pa.table({"text": texts}))
        rest = "SELECT DISTINCT unnest(string_split(regexp_replace(text, '[ -~]+', '', 'g'), '')) AS c FROM t"
        # A letter and the marks after it can count as one character there.
        chars = {x for r in self.con.execute(f"SELECT c FROM ({rest}) WHERE c <> ''").fetchall() for x in r[0]}
        steps = self.sql(sorted((chars | self.ascii) - {"\0"}))
        out = texts
        for step in steps or ():
            self.con.unregister("t")
            self.con.register("t", pa.table({"text": out}))
            out = self.con.sql(f"SELECT {step} AS form FROM t").to_arrow_table()["form"].combine_chunks().cast(pa.string())
        self.con.unregister("t")
        if steps and "\0" in chars:
            # nfc_normalize ends a text that is not ASCII at its first U+0000: such texts take the plain path.
            cut = pc.fill_null(pc.match_substring(texts, "\0"), False)
            out = pc.replace_with_mask(out, cut, pa.array([form_of(x, self.looks) for x in texts.filter(cut).to_pylist()], pa.string()))
        return out if steps else None


def look_map(lookalikes: DataFrame) -> dict[str, str]:
    """The look-alikes as a map.  Nearly all are single code points, so its size is bounded by Unicode itself; empty ones say nothing."""
    rows = lookalikes.where("looks IS NOT NULL AND plain IS NOT NULL").groupBy("looks").agg(F.min("plain").alias("plain")).collect()
    return {r["looks"]: r["plain"] for r in rows if r["looks"]}


def with_form(df: DataFrame, text: str, lookalikes: DataFrame, keep: list[str], keep_text: bool = False, then: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """``keep`` columns (and the text) plus ``form``, or what ``then`` makes of arrays of forms.  A null text has a null form, an empty or invisible one an empty
    form.  Other columns are left out, so their names cannot clash."""
    looks = look_map(lookalikes)
    rows = df.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"] + ([T.StructField("text", T.StringType())] if keep_text else []) + [T.StructField("form", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(looks)
        for b in batches:
            texts = b.column(b.schema.get_field_index("__text"))
            cols = [b.column(b.schema.get_field_index(k)) for k in keep] + ([texts] if keep_text else []) + [then(former(texts)) if then else former(texts)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def _digest(c: str):
    return F.unhex(F.sha2(F.col(c), 256))


def form_digests(docs: DataFrame, doc_id: str, text: str, lookalikes: DataFrame) -> DataFrame:
    """``id``, digest ``f`` of the form and ``t`` of the text as delivered, for documents with a non-empty form.

    Only digests move: 256 bits, so equal digests mean equal texts.  They are written once, as they are read twice.
    """
    df = with_form(docs, text, lookalikes, [doc_id], keep_text=True)
    return materialize(df.where("form <> ''").select(F.col(doc_id).alias("id"), _digest("form").alias("f"), _digest("text").alias("t")), "forms")


def lookalike_pairs(docs: DataFrame, doc_id: str, text: str, lookalikes: DataFrame) -> DataFrame:
    """All pairs of documents whose texts differ as delivered and have the same, non-empty form.

    Forms with one spelling only are dropped before the join; members of large groups are spread over salts, so no
    task makes the pairs of a whole hot group.
    """
    rows = form_digests(docs, doc_id, text, lookalikes)
    groups = rows.groupBy("f").agg(F.count("*").alias("n"), F.min("t").alias("least"), F.max("t").alias("most")).where("least <> most")
    groups = materialize(groups.select("f", "n", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")), "groups")
    members = lookup(rows, groups, "f", "n")
    a = members.select("f", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.col("id").alias("doc_id_a"), F.col("t").alias("ta"))
    b = members.select("f", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("doc_id_b"), F.col("t").alias("tb"))
    return a.join(b, ["f", "salt"]).where("doc_id_a < doc_id_b AND ta <> tb").select("doc_id_a", "doc_id_b")


def form_classes(docs: DataFrame, doc_id: str, text: str, lookalikes: DataFrame) -> DataFrame:
    """One row per document with a non-empty form: ``class_id`` (least id with that form), members and spellings of it."""
    rows = form_digests(docs, doc_id, text, lookalikes)
    spelled = rows.groupBy("f", "t").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    groups = spelled.groupBy("f").agg(F.min("id").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_spellings"))
    return lookup(rows, materialize(groups, "groups"), "f", "n_docs").select(F.col("id").alias("doc_id"), "class_id", "n_docs", "n_spellings")
