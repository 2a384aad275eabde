"""License detection by ordered signature rules, in DataFrame functions only.

A text is lower-cased in A-Z and its words (runs of digits, letters and non-ASCII characters) are joined by single
blanks. Every rule has keys: plain phrases of whole words of which each match holds one, and of each phrase a
word as its anchor. Texts without any anchor skip the rules; in the others a rule runs its pattern if a key's anchor and
phrase stand there. Every match is an interval of words. Detections are taken by priority, the
earliest and longest first, then in the order of the rules. One is suppressed where it lies inside an accepted one or
overlaps an accepted one of higher priority, so a weaker detection never suppresses a stronger one. Detections that no
chain of overlaps joins don't affect each other and are resolved apart, in clusters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.license_rules import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that tell little as anchors.
USUAL = {"license", "licence", "software", "under", "copyright", "public", "without", "terms", "provided", "version", "general"}
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that always count, with their labels, in the order of the labels.
BASE = {"apache license": "apache", "cc by": "cc-by", "gnu general public license": "gpl", "mit license": "mit"}
BASE_PATTERN = "(?<= )(?:" + "|".join(BASE) + ")(?= )"


def rules() -> list[tuple[int, str, list[tuple[str, str]], str, int]]:
    """(order, label, keys, pattern, priority) of every rule; patterns match whole words. Each match holds, for one of the
    keys, its phrase between blanks, and so its anchor, which is a word of the phrase."""
    return [(i, label, keys(core), f"(?<= ){spelt(prefix)}(?:{spelt(core)})(?= )", priority) for i, (label, prefix, core, priority) in enumerate(written())]


def spelt(pattern: str) -> str:
    """The regular expression of a pattern with #n written out."""
    return re.sub(r"#(\[\d+\]|\d+)", r"(?: version \1| v ?\1| \1)", pattern)


def _parts(pattern: str) -> list[str]:
    """The alternatives of a pattern, split outside its groups."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _items(pattern: str) -> list[tuple[str, str | bool, bool, bool]]:
    """Plain characters ("c", it, ...), groups ("g", begins with a blank, ends with one, optional) and the rest ("u", ...)."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "(":
            to, depth = i, 0
            while True:
                depth += (pattern[to] == "(") - (pattern[to] == ")")
                to += 1
                if not depth:
                    break
            inner = _parts(pattern[i + 3 : to - 1])
            optional = pattern[to : to + 1] == "?"
            out.append(("g", all(x[:1] in (" ", "#") for x in inner), all(x[-1:] == " " for x in inner), optional))
            i = to + optional
        elif m := re.match(r"#(?:\[\d+\]|\d+)", pattern[i:]):
            out.append(("g", True, False, False))
            i += len(m[0])
        elif m := re.match(r"\.\{\d+,\d+\}\?|\[[^\]]*\]\??|.\?", pattern[i:]):
            out.append(("u", False, False, False))
            i += len(m[0])
        else:
            out.append(("c", pattern[i], False, False))
            i += 1
    return out


def keys(pattern: str) -> list[tuple[str, str]]:
    """(anchor, phrase) of each alternative: its longest run of plain whole words, and of these the longest that isn't USUAL."""

    def bounded(items, k: int, step: int) -> bool:
        if not 0 <= k < len(items):
            return True
        kind, first, last, optional = items[k]
        if kind == "c":
            return first == " "
        return kind == "g" and bool(last if step < 0 else first) and (not optional or bounded(items, k + step, step))

    out = set()
    for part in _parts(pattern):
        items = _items(part)
        runs, k = [], 0
        while k < len(items):
            if items[k][0] != "c" or items[k][1] == " ":
                k += 1
                continue
            to = k
            while to < len(items) and items[to][0] == "c" and items[to][1] != " ":
                to += 1
            if bounded(items, k - 1, -1) and bounded(items, to, 1):
                word = "".join(items[j][1] for j in range(k, to))
                joined = runs and runs[-1][1] == k - 1 and items[k - 1][:2] == ("c", " ")
                runs = [*runs[:-1], (runs[-1][0] + [word], to)] if joined else [*runs, ([word], to)]
            k = to
        best = max((r for r, _ in runs), key=lambda r: (max(w not in USUAL for w in r), len(" ".join(r))))
        out.add((max(best, key=lambda w: (w not in USUAL, len(w), w)), f" {' '.join(best)} "))
    return sorted(out)


def normal(text: Column) -> Column:
    """' word word ' of a text; two blanks if it has no word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), DELIMITERS, " ")), F.lit(" "))


def _blanks(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


_TYPE = "array<struct<s:int,e:int,p:int,i:int,label:string>>"

#: Word intervals of one rule r in `norm`: each match is fenced, the text cut at the fences, and blanks are counted.
_MATCHES = f"""transform(array(split(regexp_replace(norm, r.pattern, '\u0001$0\u0002'), '\u0001')), cut -> aggregate(
  slice(cut, 2, 1000000000),
  named_struct('words', {_blanks("cut[0]")}, 'found', cast(array() as {_TYPE})),
  (acc, x) -> named_struct(
    'words', acc.words + {_blanks("x")},
    'found', concat(acc.found, array(named_struct('s', acc.words - 1, 'e', -(acc.words + {_blanks("substring_index(x, '\u0002', 1)")}), 'p', -r.priority, 'i', r.i, 'label', r.label)))
  ),
  acc -> acc.found
))[0]"""

#: All intervals by start, the longest first; ends and priorities are held negative.
_DETECTED = f"""array_sort(flatten(transform(filter(RULES, r -> exists(r.keys, k -> array_contains(present, k.anchor) and contains(norm, k.phrase))), r -> {_MATCHES})))"""

#: Runs of detections that a chain of overlaps joins.
_CLUSTERS = f"""aggregate(
  detected,
  named_struct('done', cast(array() as array<{_TYPE}>), 'own', cast(array() as {_TYPE}), 'e', 0),
  (acc, d) -> if(d.s < acc.e,
    named_struct('done', acc.done, 'own', concat(acc.own, array(d)), 'e', greatest(acc.e, -d.e)),
    named_struct('done', if(size(acc.own) = 0, acc.done, concat(acc.done, array(acc.own))), 'own', array(d), 'e', -d.e)),
  acc -> if(size(acc.own) = 0, acc.done, concat(acc.done, array(acc.own)))
)"""

_ACCEPTED = f"""flatten(transform(clusters, c -> aggregate(
  array_sort(transform(c, d -> named_struct('p', d.p, 's', d.s, 'e', d.e, 'i', d.i, 'label', d.label))),
  cast(array() as array<struct<p:int,s:int,e:int,i:int,label:string>>),
  (acc, d) -> if(exists(acc, a -> (a.s <= d.s and a.e <= d.e) or (a.p < d.p and a.s < -d.e and d.s < -a.e)), acc, concat(acc, array(d)))
)))"""


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row, from the whole text.

    n_base counts the places of the BASE phrases; first_word and last_word are the first and last of their start words,
    null without one. labels joins the base labels and those of the detections that stand; score is the highest priority
    of these over 100, at least 0.5 with a base phrase, else 0. Null and empty texts have no words and no labels.
    Repeated rows and rows without a doc_id are answered one by one, an empty table gives no rows, other columns are ignored. Nothing is shuffled.
    """
    any_of = lambda words: " or ".join(f"contains(norm, '{w}')" for w in words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("norm"))
    rows = rows.withColumn("has_base", F.expr(any_of(f" {p} " for p in BASE)))
    every = rules()
    known = sorted({anchor for _, _, keys, _, _ in every for anchor, _ in keys})
    rows = rows.withColumn("present", F.expr(f"array_intersect(array({', '.join(map(repr, known))}), split(norm, ' '))"))
    pairs = lambda keys: "array(" + ", ".join(f"named_struct('anchor', '{a}', 'phrase', '{p}')" for a, p in keys) + ")"
    literal = "array(" + ", ".join(f"named_struct('i', {i}, 'label', '{label}', 'keys', {pairs(keys)}, 'pattern', '{pattern}', 'priority', {priority})" for i, label, keys, pattern, priority in every) + ")"
    rows = rows.withColumn("detected", F.expr(f"coalesce(case when size(present) > 0 then {_DETECTED.replace('RULES', literal)} end, cast(array() as {_TYPE}))"))
    rows = rows.withColumn("clusters", F.expr(_CLUSTERS)).withColumn("kept", F.expr(_ACCEPTED))
    base = F.array_compact(F.array(*(F.when(F.contains("norm", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items())))
    before = lambda greedy: f"case when has_base then cast({_blanks(f'regexp_extract(norm, {chr(39)}(?s)^(.*{greedy}){BASE_PATTERN}{chr(39)}, 1)')} - 1 as bigint) end"
    return rows.withColumn("base", base).select(
        "doc_id",
        F.expr(f"case when norm = '  ' then 0L else cast({_blanks('norm')} - 1 as bigint) end").alias("n_words"),
        F.expr(f"case when has_base then cast(regexp_count(norm, '{BASE_PATTERN}') as bigint) else 0L end").alias("n_base"),
        F.expr(before("?")).alias("first_word"),
        F.expr(before("")).alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.expr("transform(kept, d -> d.label)")))).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.expr("coalesce(array_max(transform(kept, d -> -d.p)), 0) / 100D")).alias("score"),
    )
