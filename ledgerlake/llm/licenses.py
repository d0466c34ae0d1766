"""License scans with a positional rare-token index, with DataFrame functions only.

Each template has a label, the words of its usual notice, and a mandatory key phrase within them. One pass over the texts
keeps the positions of words that stand in some notice, as a written table that is a small part of the input; all else
works on it. It tells in how many documents each such word occurs; each template is then posted under the rarest word of
its key phrase (the highest IDF), with positions. The index is an array by word, so a word finds its postings in one
step, however many templates there are. Where that word stands in a text, a template's postings are intersected by
relative position - its other rare words must stand where the rarest one puts them - and then the whole key phrase is
verified there. The score is the share of a notice's words that stand in place, the best of all matches.

All of it is local to a row: texts aren't shuffled, and the index is as small as the list of templates.

Defined cases: a null text is empty: no words, no labels, score 0, first_word and last_word null; repeated rows and null
ids give a row each; an empty table gives no rows; the result has doc_id and its own columns, so other columns can't
clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def offset(self) -> int:
        """Where the key phrase stands in the notice."""
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: Notices as licences word them, in lower case, split as texts are (fixed values).
TEMPLATES = (
    Template("gpl", "licensed under the gnu general public license", "gnu general public license", True),
    Template("apache", "licensed under the apache license", "apache license", True),
    Template("cc-by", "licensed under cc by", "cc by", True),
    Template("mit", "released under the mit license", "mit license", True),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    Template("cc0", "released under cc0 1 0 universal", "cc0 1 0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute this software"),
)
#: Words under which a key phrase is posted at most.
RARE = 2


def text_words(text: Column) -> Column:
    """The words of a text, A-Z as a-z. lower() maps the Kelvin sign to k; that sign is swapped for another letter first, as only A-Z are to change."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def vocabulary(templates: Sequence[Template]) -> list[str]:
    """The words of all notices; a word's code is its place here."""
    return sorted({w for t in templates for w in t.words})


def hits(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and hits: at (position, ascending) and word (code) of the words that stand in a notice. The only look at the texts."""
    known = vocabulary(templates)
    codes = F.array(*map(F.lit, known))
    found = F.filter(F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(i.alias("at"), w.alias("w")))), lambda x: x.isNotNull())
    coded = F.transform(found, lambda x: F.struct(x["at"].alias("at"), (F.array_position(codes, x.w) - 1).cast("int").alias("word")))
    return docs.select("doc_id", text_words(F.col("text")).alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), coded.alias("hits"))


def document_frequency(found: DataFrame, templates: Sequence[Template] = TEMPLATES) -> dict[str, int]:
    """Documents with each word of the notices, from hits(); what comes back is as long as that list of words."""
    words = found.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x.word))).alias("word"))
    known = vocabulary(templates)
    return {w: 0 for w in known} | {known[r.word]: r["count"] for r in words.groupBy("word").count().collect()}


def postings(templates: Sequence[Template], df: dict[str, int], rare: int = RARE) -> list[tuple[Template, list[tuple[str, int]]]]:
    """Of each template its rarest key words with their positions in the notice, rarest first."""
    out = []
    for t in templates:
        at = [(w, t.offset + i) for i, w in enumerate(t.key.split())]
        out.append((t, sorted(at, key=lambda x: (df.get(x[0], 0), x[1]))[:rare]))
    return out


def _literal(index: list[tuple[Template, list[tuple[str, int]]]], code: dict[str, int]) -> Column:
    """The index: for each word's code the templates of which it is the rarest word, with that word's position."""
    pairs = lambda ws: F.array(*(F.struct(F.lit(code[w]).alias("w"), F.lit(i).alias("i")) for w, i in ws))
    posted: dict[int, list[Column]] = {}
    for t, rare in index:
        posted.setdefault(code[rare[0][0]], []).append(
            F.struct(
                F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(rare[0][1]).alias("at"), pairs(rare).alias("rare"),
                pairs((w, t.offset + i) for i, w in enumerate(t.key.split())).alias("key"), pairs((w, i) for i, w in enumerate(t.words)).alias("notice"), F.lit(t.offset).alias("offset"),
            )
        )
    none = F.slice(F.array(*next(iter(posted.values()))), 1, 0)
    return F.array(*(F.array(*posted[c]) if c in posted else none for c in range(len(code))))


def matches(index: list[tuple[Template, list[tuple[str, int]]]], templates: Sequence[Template]) -> Column:
    """Array of label, base, word (where the key phrase starts) and score, from the column hits.

    Hits stand in the order of their positions, so the words of a phrase that stands in the text are neighbours there, and
    all that stand within a notice's length of one are within as many neighbours."""
    code = {w: i for i, w in enumerate(vocabulary(templates))}
    anchors = sorted({code[rare[0][0]] for _, rare in index})
    reach = max(len(t.words) for t in templates)
    table = _literal(index, code)
    places = F.filter(F.transform("hits", lambda x, j: F.when(x.word.isin(anchors), j)), lambda j: j.isNotNull())

    def here(j: Column) -> Column:
        place = F.get(F.col("hits"), j)["at"]

        def stands(t: Column):
            def one(q: Column) -> Column:
                x = F.get(F.col("hits"), j + q.i - t["at"])
                return F.coalesce((x["at"] == place + q.i - t["at"]) & (x["word"] == q.w), F.lit(False))

            return one

        near = F.slice("hits", F.greatest(j - reach, F.lit(0)) + 1, 2 * reach + 1)
        in_place = lambda t: F.filter(t.notice, lambda q: F.exists(near, lambda x: (x["at"] == place + q.i - t["at"]) & (x.word == q.w)))
        aligned = F.filter(F.get(table, F.get(F.col("hits"), j)["word"]), lambda t: F.forall(t.rare, stands(t)))
        verified = F.filter(aligned, lambda t: F.forall(t.key, stands(t)))
        return F.transform(verified, lambda t: F.struct(t.label.alias("label"), t.base.alias("base"), (place - t["at"] + t.offset).alias("word"), (F.size(in_place(t)) / F.size(t.notice)).alias("score")))

    return F.flatten(F.transform(places, here))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, rare: int = RARE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches (label, base, word, score)."""
    found = Scratch(docs.sparkSession, "licenses").save(hits(docs, templates), "hits")
    index = postings(templates, document_frequency(found, templates), rare)
    found = found.select("doc_id", "n_words", matches(index, templates).alias("matches"))
    base = F.filter("matches", lambda m: m.base)
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x.label))), ",")
    starts = F.transform(base, lambda m: m.word)
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m.score)), F.lit(0.0)).alias("score"), "matches")
