"""Subject-verb-object triples of sentences that a parser has annotated.

A parser is a boundary (see ``models``): its output is an array of tokens with part of speech, dependency
label and head. The rules walk each sentence's tree once, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENS = "array<struct<text:string,lemma:string,pos:string,dep:string,head:int>>"
TRIPLES = "array<struct<subj:struct<text:string,idx:array<int>>,verb:struct<lemma:string,idx:int>,obj:struct<text:string,idx:array<int>>>>"

# Dependency labels and words of the rules.
SUBJECT = {"nsubj", "nsubjpass", "csubj", "csubjpass", "agent", "expl"}
OBJECT = {"dobj", "dative", "attr", "oprd"}
AUXILIARY = {"aux", "auxpass"}
BREAKERS = {"CCONJ", "VERB"}
CONJUNCTIONS = {"and", "or", "nor", "but", "yet", "so", "for"}
NEGATIONS = {"no", "not", "n't", "never", "none"}


@dataclass
class Token:
    i: int
    text: str
    lemma: str
    pos: str
    dep: str
    head: int


class Sentence:
    def __init__(self, rows: list[dict]):
        self.tokens = [Token(i, r["text"] or "", r["lemma"] or r["text"] or "", r["pos"] or "", r["dep"] or "", i if r["head"] is None else r["head"]) for i, r in enumerate(rows)]
        self.children: list[list[Token]] = [[] for _ in rows]
        for t in self.tokens:
            if t.head != t.i and 0 <= t.head < len(rows):
                self.children[t.head].append(t)

    def verbs(self) -> list[Token]:
        """Main verbs; without any, auxiliaries."""
        main = [t for t in self.tokens if t.pos == "VERB" and t.dep not in AUXILIARY]
        return main or [t for t in self.tokens if t.pos in ("VERB", "AUX")]

    def negated(self, t: Token) -> bool:
        return any(c.text.lower() in NEGATIONS for c in self.children[t.i])

    def has_conjunction(self, t: Token, strict: bool = False) -> bool:
        """Whether something right of ``t`` on it coordinates: a conjunction, or unless ``strict`` the label alone."""
        right = [c for c in self.children[t.i] if c.i > t.i]
        return any(c.text.lower() in CONJUNCTIONS for c in right) or not strict and any(c.dep == "conj" for c in right)

    def joined(self, heads: list[Token]) -> list[Token]:
        """``heads`` and what is coordinated with them."""
        out, todo = [], list(heads)
        while todo:
            t = todo.pop(0)
            if t not in out:
                out.append(t)
                if not self.has_conjunction(t):
                    continue
                todo += [c for c in self.children[t.i] if c.dep == "conj" and c.pos in ("NOUN", "PROPN", "PRON")]
        return out

    def subjects(self, verb: Token) -> tuple[list[Token], bool]:
        """Subjects of ``verb``, taken from the verb it is joined to where it has none, and whether one up there is negated."""
        negated, seen = self.negated(verb), set()
        while verb.i not in seen:
            seen.add(verb.i)
            found = [c for c in self.children[verb.i] if c.dep in SUBJECT and c.i < verb.i and c.pos != "DET"]
            if found:
                return self.joined(found), negated
            up = self.tokens[verb.head]
            if up.i == verb.i:
                break
            if up.pos == "NOUN":
                return [up], negated or self.negated(up)
            negated, verb = negated or self.negated(up), up
        return [], negated

    def objects(self, verb: Token, passive: bool) -> list[Token]:
        """Direct objects, objects of prepositions, and those of an open complement."""
        right = [c for c in self.children[verb.i] if c.i > verb.i]
        found = [c for c in right if c.dep in OBJECT or passive and c.dep == "pobj"]
        for c in right:
            if c.pos == "ADP" and (c.dep == "prep" or passive and c.dep == "agent"):
                found += [g for g in self.children[c.i] if g.i > c.i and (g.dep in OBJECT or g.dep == "pobj" or g.pos == "PRON" and g.lemma == "me")]
            elif c.dep == "xcomp" and c.pos == "VERB" and not found:
                found += self.objects(c, False)
        return self.joined(found)

    def span(self, t: Token) -> dict:
        """The phrase of ``t``: what hangs on it, without coordinated parts, clauses and negations. A "that" stands for what its
        clause hangs on."""
        if t.text.lower() == "that":
            t = next((self.tokens[x.head] for x in self.tokens if any(c.i < x.i and c.text.lower() == "that" for c in self.children[x.i])), t)
        held, todo = {t.i}, [t]
        while todo:
            for c in self.children[todo.pop().i]:
                if c.pos not in BREAKERS and c.dep != "conj" and c.text.lower() not in NEGATIONS and c.i not in held:
                    held.add(c.i)
                    todo.append(c)
        index = sorted(held)
        return {"text": " ".join(self.tokens[i].text for i in index), "idx": index}

    def triples(self) -> list[dict]:
        out = []
        for verb in self.verbs():
            passive = any(c.dep == "auxpass" for c in self.children[verb.i])
            subjects, negated = self.subjects(verb)
            heads = [verb] + [c for c in self.children[verb.i] if c.dep == "conj" and c.pos == "VERB" and c.i > verb.i and not any(g.dep in SUBJECT for g in self.children[c.i])][:1]
            for subject in subjects:
                for v in heads:
                    objects = self.objects(v, passive)
                    mark = "!" if negated or self.negated(v) else ""
                    lemma = {"lemma": mark + v.lemma.lower(), "idx": v.i}
                    for target in objects or [None]:
                        s, o = self.span(subject), None if target is None else self.span(target)
                        triple = {"subj": o, "verb": lemma, "obj": s} if passive else {"subj": s, "verb": lemma, "obj": o}
                        if triple not in out:
                            out.append(triple)
        return out


def extract(df: DataFrame, kept: list[str], tokens: str) -> DataFrame:
    """Columns ``kept`` and ``svos``. ``tokens`` is of type TOKENS; null or empty gives an empty array."""
    from pyspark.sql import types as T

    rows = df.select(*kept, tokens)
    schema = T.StructType([*df.select(*kept).schema.fields, *T._parse_datatype_string(f"svos {TRIPLES}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase = pa.struct([("text", pa.string()), ("idx", pa.list_(pa.int32()))])
        kind = pa.list_(pa.struct([("subj", phrase), ("verb", pa.struct([("lemma", pa.string()), ("idx", pa.int32())])), ("obj", phrase)]))
        for batch in batches:
            found = [Sentence([t for t in s if t]).triples() if s else [] for s in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def head_of_phrase(rows: list[dict]) -> tuple[str, int] | None:
    """Lemma and place of a parsed phrase's root."""
    s = Sentence(rows)
    return next(((t.lemma, t.i) for t in s.tokens if t.head == t.i), None)
