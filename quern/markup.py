"""The wire format of annotated documents: parse, validate, render, repair.

A wire is ``<text>`` + escaped text with ``<span>..<annotation type= why= score= /></span>`` around annotated parts (they may nest) +
``<verdict type= why= score= /></text>``.  The functions here work on one string; ``*_udf`` wrap them for Arrow batches, since
matching nested tags depends on order and has no built-in counterpart.
"""

from __future__ import annotations

import difflib
import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TELL = "ord int, span_text string, explanation string, type string, score double, start int, end int, nested boolean"
VERDICT = "type string, why string, score double"
PARSED = f"ok boolean, plain string, tells array<struct<{TELL.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>, verdict struct<{VERDICT.replace(' string', ':string').replace(' double', ':double')}>"
KINDS = ("AI", "human")
DEEPEST = 256
END_MARK = "<|return|>"
_ATTR = r'(?:\s+[a-z]+="(?:[^"\\]|\\.)*")*\s*'
_TAGS = re.compile(rf"<span>|</span>|<annotation{_ATTR}/>|<verdict{_ATTR}/>|<text>|</text>")
_PAIR = re.compile(r'([a-z]+)="((?:[^"\\]|\\.)*)"')
_FORBIDDEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape(text: str) -> str:
    text = _FORBIDDEN.sub("", text)
    for raw, entity in _ENTITIES:
        text = text.replace(raw, entity)
    return text


def unescape(text: str) -> str:
    return html.unescape(text)


def _attributes(tag: str) -> dict:
    """Type, explanation and score of a tag; ``good`` says whether they are complete and the score lies in 0..1."""
    found = dict(_PAIR.findall(tag))
    why = unescape(re.sub(r"\\(.)", r"\1", found.get("why", ""))).strip()
    raw = found.get("score", "0.5")
    score = float(raw) if re.fullmatch(r"\d*\.?\d+", raw) else -1.0
    return {"type": found.get("type", ""), "why": why, "score": score, "good": bool(why) and 0 <= score <= 1 and "type" in found}


def _pieces(wire: str):
    """Alternating text runs and tags of a wire."""
    at = 0
    for m in _TAGS.finditer(wire):
        if m.start() > at:
            yield "run", wire[at : m.start()]
        yield "tag", m.group()
        at = m.end()
    if at < len(wire):
        yield "run", wire[at:]


def parse(wire: str | None) -> dict:
    """``ok, plain, tells, verdict`` of a wire; a wire that isn't well-formed is not ok, with its text as far as it could be read.

    Tells come in the order in which their spans open; offsets count characters of the plain text.
    """
    wire = (wire or "").removesuffix(END_MARK)
    out, length = [], 0
    stack: list[dict] = []
    tells: list[dict] = []
    verdict, ok, state = None, True, "before"
    for kind, piece in _pieces(wire):
        if kind == "run":
            if state != "inside" or "<" in piece or (stack and stack[-1]["meta"]):
                ok = False
            text = unescape(piece)
            out.append(text)
            length += len(text)
        elif piece == "<text>":
            ok, state = ok and state == "before", "inside"
        elif piece == "</text>":
            ok, state = ok and state == "closing", "after"
        elif piece == "<span>":
            ok = ok and state == "inside" and len(stack) < DEEPEST and not (stack and stack[-1]["meta"])
            stack.append({"ord": len(tells), "start": length, "meta": None})
            tells.append(stack[-1])
        elif piece == "</span>":
            if not stack or not stack[-1]["meta"]:
                ok = False
            if stack:
                stack.pop()["end"] = length
        elif piece.startswith("<annotation"):
            if stack and not stack[-1]["meta"]:
                stack[-1]["meta"] = _attributes(piece)
                ok = ok and stack[-1]["meta"]["good"]
            else:
                ok = False
        else:
            verdict = _attributes(piece)
            ok, state = ok and state == "inside" and not stack and verdict["good"] and verdict["type"] in KINDS, "closing"
    ok = ok and state == "after" and not stack and verdict is not None
    plain = "".join(out)
    rows, open_until = [], 0
    for t in tells:
        if t["meta"] and "end" in t:
            m = t["meta"]
            rows.append({"ord": t["ord"], "span_text": plain[t["start"] : t["end"]], "explanation": m["why"], "type": m["type"], "score": m["score"], "start": t["start"], "end": t["end"], "nested": t["start"] < open_until})
            open_until = max(open_until, t["end"])
    v = {k: verdict[k] for k in ("type", "why", "score")} if verdict else None
    return {"ok": ok, "plain": plain, "tells": rows, "verdict": v}


def difference(a: str, b: str) -> int:
    """Characters of both texts outside their matching blocks."""
    if a == b:
        return 0
    head = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return len(a) + len(b) - 2 * same


def diagnose(wire: str | None, document: str | None, measure=difference) -> dict:
    """``ok, reason, char_diff``: the first rule a wire breaks as an annotation of ``document``; ``measure`` counts the characters that differ, which takes long for long texts."""
    wire, document = (wire or "").removesuffix(END_MARK), document or ""
    if not wire:
        return {"ok": False, "reason": "empty_final", "char_diff": len(document)}
    if not (wire.startswith("<text>") and wire.endswith("</text>") and "<verdict " in wire):
        return {"ok": False, "reason": "missing_outer_annotation", "char_diff": measure(wire, document)}
    p = parse(wire)
    if not p["ok"]:
        return {"ok": False, "reason": "annotation_parse_failed", "char_diff": measure(p["plain"], document)}
    if any(t["type"] not in KINDS for t in p["tells"]):
        return {"ok": False, "reason": "invalid_type", "char_diff": measure(p["plain"], document)}
    if p["plain"] != _FORBIDDEN.sub("", document):
        return {"ok": False, "reason": "text_mismatch", "char_diff": measure(p["plain"], document)}
    if any(kind == "run" and escape(unescape(piece)) != piece for kind, piece in _pieces(wire)):
        return {"ok": False, "reason": "bad_xml_escaping", "char_diff": 0}
    return {"ok": True, "reason": "ok", "char_diff": 0}


def _tag(name: str, kind: str, why: str, score: float) -> str:
    return f'<{name} type="{escape(kind)}" why="{escape(why.strip())}" score="{score:g}" />'


def render(document: str, tells: list[dict], verdict: dict) -> str:
    """The canonical wire.  Tells have ``start, end, type, explanation, score``; one that crosses another is left out."""
    kept: list[dict] = []
    for t in sorted(tells, key=lambda t: (t["start"], -t["end"])):
        if 0 <= t["start"] < t["end"] <= len(document) and not any(k["start"] < t["start"] < k["end"] < t["end"] for k in kept):
            kept.append(t)
    out: list[str] = ["<text>"]
    at = 0
    inner: list[dict] = []

    def close_until(position: int) -> None:
        nonlocal at
        while inner and inner[-1]["end"] <= position:
            t = inner.pop()
            out.append(escape(document[at : t["end"]]))
            at = t["end"]
            out.append(_tag("annotation", t["type"], t["explanation"], t["score"]) + "</span>")

    for t in kept:
        close_until(t["start"])
        out.append(escape(document[at : t["start"]]) + "<span>")
        at = t["start"]
        inner.append(t)
    close_until(len(document))
    out.append(escape(document[at:]) + _tag("verdict", verdict["type"], verdict["why"], verdict["score"]) + "</text>")
    return "".join(out)


def locate(document: str, spans: list[str]) -> list[tuple[int, int] | None]:
    """Places of spans in order: the first occurrence from where the last one ended, else the first that meets no other; None if there is none."""
    taken: list[tuple[int, int]] = []
    cursor, out = 0, []
    for s in spans:
        place = None
        if s:
            at = document.find(s, cursor)
            free = lambda p, s=s: all(p + len(s) <= a or p >= b for a, b in taken)
            if at >= 0 and free(at):
                place = (at, at + len(s))
            else:
                at = document.find(s)
                while at >= 0 and not free(at):
                    at = document.find(s, at + 1)
                place = (at, at + len(s)) if at >= 0 else None
        if place:
            taken.append(place)
            cursor = max(cursor, place[1])
        out.append(place)
    return out


def repair(wire: str | None, document: str, most: float = 0.2) -> str | None:
    """A valid wire of ``document`` from a broken one, or None.

    Attribute spelling is normalized, tags without a partner are dropped, the score of the verdict is clamped, and the text is replaced by the document's:
    spans keep their explanation and move to where their text stands in the document; spans that stand nowhere are dropped, and none is invented.
    None if the verdict is missing or the wire's text differs from the document by more than ``most`` of its length (and by more than 8 characters).
    """
    wire = (wire or "").removesuffix(END_MARK)
    document = _FORBIDDEN.sub("", document)
    if diagnose(wire, document)["ok"]:
        return wire
    wire = re.sub(r'type="\s*(ai|human)\s*"', lambda m: f'type="{"AI" if m.group(1).lower() == "ai" else "human"}"', wire, flags=re.I)
    wire = re.sub(r'score="\s*(-?\d*\.?\d+)\s*"', lambda m: f'score="{min(1.0, max(0.0, float(m.group(1)))):g}"', wire)
    for _ in range(6):
        once = re.sub(r"&amp;(quot|apos);", r"&\1;", wire)
        if once == wire:
            break
        wire = once
    p = parse(wire)
    v = p["verdict"]
    if not v or v["type"] not in KINDS or not v["why"]:
        return None
    off = difference(p["plain"].strip(), document.strip())
    if off > max(8, most * max(len(document), 1)):
        return None
    tells = [t for t in p["tells"] if t["type"] in KINDS and t["explanation"] and 0 <= t["score"] <= 1]
    outer = [t for t in tells if not t["nested"]]
    moved = [dict(t, start=place[0], end=place[1]) for t, place in zip(outer, locate(document, [t["span_text"] for t in outer]), strict=True) if place]
    for t in (t for t in tells if t["nested"]):  # a nested span stays within the span that held it
        for o, m in ((o, m) for o in outer for m in moved if m["ord"] == o["ord"]):
            if o["start"] <= t["start"] and t["end"] <= o["end"]:
                at = document.find(t["span_text"], m["start"], m["end"])
                if at >= 0:
                    moved.append(dict(t, start=at, end=at + len(t["span_text"])))
                break
    fixed = render(document, moved, {"type": v["type"], "why": v["why"], "score": min(1.0, max(0.0, v["score"]))})
    return fixed if diagnose(fixed, document)["ok"] else None


def _parsed(wires: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(w) for w in wires], columns=["ok", "plain", "tells", "verdict"])


def _diagnosed(wires: pd.Series, documents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([diagnose(w, d) for w, d in zip(wires, documents, strict=True)], columns=["ok", "reason", "char_diff"])


def _reasons(wires: pd.Series, documents: pd.Series) -> pd.Series:
    return pd.Series([diagnose(w, d, lambda a, b: 0)["reason"] for w, d in zip(wires, documents, strict=True)], dtype=object)


def _repaired(wires: pd.Series, documents: pd.Series) -> pd.Series:
    return pd.Series([repair(w, d or "") for w, d in zip(wires, documents, strict=True)], dtype=object)


def _rendered(documents: pd.Series, tells: pd.Series, verdicts: pd.DataFrame) -> pd.Series:
    return pd.Series([render(d, [dict(t) for t in ts], v) for d, ts, v in zip(documents, tells, verdicts.to_dict("records"), strict=True)], dtype=object)


def _vectorized(f, returns: str):
    """A vectorized function of columns; made when it is called, as its type needs a session."""

    def call(*columns: Column | str) -> Column:
        return F.pandas_udf(f, returns)(*columns)

    return call


parse_udf = _vectorized(_parsed, PARSED)
diagnose_udf = _vectorized(_diagnosed, "ok boolean, reason string, char_diff int")
reason_udf = _vectorized(_reasons, "string")
repair_udf = _vectorized(_repaired, "string")
render_udf = _vectorized(_rendered, "string")


def strip_scores(wire: Column) -> Column:
    """The wire without the scores of its annotations."""
    return F.regexp_replace(wire, r'(<annotation [^>]*?) score="[^"]*"', "$1")


def annotation_rows(wire: Column) -> Column:
    """Array of ``struct(type, why, score)`` of all annotation tags, also of wires that aren't well-formed; without nesting or offsets, it stays in the JVM."""
    from quern.functions.text import unescape_document

    tags = F.regexp_extract_all(wire, F.lit(r"<annotation [^>]*/>"), F.lit(0))
    attr = lambda t, a: F.regexp_extract(t, rf"""{a}=(?:"([^"]*)"|'([^']*)')""", 1)
    rows = F.transform(tags, lambda t: F.struct(attr(t, "type").alias("type"), F.trim(unescape_document(attr(t, "why"))).alias("why"), attr(t, "score").try_cast("double").alias("score")))
    return F.filter(rows, lambda r: r["why"] != "")


def nearest(document: str, span: str, first: int, hint: int) -> int | None:
    """The occurrence of ``span`` from ``first`` on that lies nearest to ``hint`` (the earlier of two)."""
    best, at = None, document.find(span, first) if span else -1
    while at >= 0:
        if best is None or abs(at - hint) < abs(best - hint):
            best = at
        at = document.find(span, at + 1)
    return best


def fuzzy_place(document: str, span: str, first: int = 0) -> tuple[int, int] | None:
    """Start and length of the stretch nearest to ``span`` in characters that differ, two shorter to three longer, within max(5, a sixth of both); the first of equals.

    Characters that a stretch and the span don't have in common are a lower bound of the difference; stretches whose bound is too high are passed over
    without a comparison, which loses none.
    """
    best, codes = None, np.frombuffer(document.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    wanted = {c: span.count(c) for c in set(span)}
    running = {c: np.r_[0, np.cumsum(codes == ord(c))] for c in wanted}
    for length in range(max(1, len(span) - 2), len(span) + 4) if span else ():
        if length > len(document) - first:
            continue
        most = max(5, (len(span) + length) // 6)
        common = sum(np.minimum(r[first + length :] - r[first : len(r) - length], wanted[c]) for c, r in running.items())
        apart = len(span) + length - 2 * common
        for at in np.flatnonzero(apart <= (most if best is None else min(most, best[0]))):
            if best and apart[at] > best[0]:
                continue
            off = difference(document[first + at : first + at + length], span)
            if off <= most and (best is None or (off, first + at) < best[:2]):
                best = (off, int(first + at), length)
    return best[1:] if best else None


def _differences(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difference(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _located(documents: pd.Series, spans: pd.Series) -> pd.Series:
    place = lambda p: {"start": p[0], "end": p[1]} if p else None
    return pd.Series([[place(p) for p in locate(d, list(s))] for d, s in zip(documents, spans, strict=True)], dtype=object)


def _nearest(documents: pd.Series, spans: pd.Series, first: pd.Series, hints: pd.Series) -> pd.Series:
    return pd.Series([nearest(d, s, int(f), int(h)) for d, s, f, h in zip(documents, spans, first, hints, strict=True)], dtype="Int64")


def _fuzzy(documents: pd.Series, spans: pd.Series) -> pd.Series:
    got = (fuzzy_place(d, s) for d, s in zip(documents, spans, strict=True))
    return pd.Series([p[0] if p else None for p in got], dtype="Int64")


difference_udf = _vectorized(_differences, "bigint")
locate_udf = _vectorized(_located, "array<struct<start:int,end:int>>")
nearest_udf = _vectorized(_nearest, "bigint")
fuzzy_udf = _vectorized(_fuzzy, "bigint")
