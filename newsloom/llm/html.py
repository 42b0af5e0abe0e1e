"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

The trees are trained by Spark ML on pages that a small generator writes with known answers (menus,
headers, footers, sidebars, notices, adverts, forms and comments around an article, under many
names and shapes), since no table says which part of a page is its article. Pages are then parsed
and scored where they lie, with no shuffle.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import dom
from newsloom.llm.trees import Trees, boosted, kept
from newsloom.llm.util import arrow_map, materialize, slices, table

#: In front of every piece of text that does not belong to the article, in training pages only.
MARK = ""


class Writer:
    """Writes one training page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        vowel, other = "aeiouéöü", "bcdfglmnprstvw"
        self.syllables = [self.r.choice(other) + self.r.choice(vowel) for _ in range(40)]

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out, left = [], 0
        for _ in range(n):
            w = "".join(self.r.choices(self.syllables, k=self.r.randint(1, 3)))
            out.append(w.capitalize() if not left else w)
            left = self.r.randint(4, 14) if not left else left - 1
            if left == 0:
                out[-1] += self.r.choice(".,.!")
        return " ".join(out)

    def bad(self, low: int, high: int) -> str:
        return MARK + self.words(low, high)

    def name(self, *groups: str) -> str:
        """A class or id that names one of the groups, or nothing that tells."""
        r = self.r
        word = r.choice(" ".join(dom.HINTS[g] for g in groups).split()) if groups and r.random() < 0.8 else None
        lead = r.choice(("site", "page", "c", "l", "block", "x1", "js"))
        tail = r.choice(("", "", "-wrap", "_inner", "-2", "Box", "-list"))
        value = f"{lead}-{word}{tail}" if word and r.random() < 0.5 else f"{word}{tail}" if word else f"{lead}{r.randint(1, 99)}"
        return "" if not word and r.random() < 0.5 else f' {r.choice(("class", "class", "id"))}="{value}"'

    def box(self, inside: str, tags: tuple[str, ...], *groups: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.name(*groups)}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/x">{self.bad(1, 4)}</a></li>' if self.r.random() < 0.8 else f'<a href="/x">{self.bad(1, 3)}</a> ' for _ in range(self.r.randint(low, high))]
        return "<ul>" + "".join(items) + "</ul>"

    def text(self, low: int, high: int, p: float = 0.5) -> str:
        return "".join(f"<p>{self.bad(3, 60)}</p>" for _ in range(self.r.randint(low, high))) if self.r.random() < p else self.bad(3, 40)

    def junk(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.box(self.links(2, 12), ("nav", "nav", "div", "ul", "header"), "menu")
        if kind == "header":
            return self.box(f"<a href=/>{self.bad(1, 4)}</a>" + (f"<p>{self.bad(2, 10)}</p>" if r.random() < 0.5 else "") + (self.links(2, 6) if r.random() < 0.4 else ""), ("header", "header", "div"), "edge")
        if kind == "footer":
            return self.box((f"&copy; {self.bad(2, 20)}" if r.random() < 0.7 else self.text(1, 3)) + (self.links(1, 6) if r.random() < 0.4 else ""), ("footer", "footer", "div"), "edge")
        if kind == "side":
            return self.box(f"<h3>{self.bad(1, 4)}</h3>" + (self.links(2, 10) if r.random() < 0.6 else self.text(1, 4, 0.8)), ("aside", "aside", "div", "section"), "side")
        if kind == "advert":
            return self.box(self.text(1, 2, 0.3) + (f"<a href=/>{self.bad(1, 5)}</a>" if r.random() < 0.3 else ""), ("div", "div", "aside", "section"), "advert")
        if kind == "notice":
            return self.box(self.text(1, 2, 0.5) + (f"<button>{self.bad(1, 2)}</button>" if r.random() < 0.6 else ""), ("div", "section", "aside"), "notice")
        if kind == "reader":
            one = lambda: self.box((f"<b>{self.bad(1, 2)}</b>" if r.random() < 0.5 else "") + f"<p>{self.bad(3, 80)}</p>", ("div", "li", "article"), "reader")
            return self.box(f"<h3>{self.bad(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 8))), ("section", "div", "ol"), "reader")
        if kind == "share":
            return self.box(self.links(2, 6), ("div", "ul", "p"), "share")
        return f"<form{self.name('form')}><label>{self.bad(1, 5)}</label><input name=q>{self.text(0, 1)}<button>{self.bad(1, 2)}</button></form>"

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.words(1, 12)}</h1>"] if r.random() < 0.85 else []
        count, style = r.choice((1, 1, 2, 3, 5, 8, 14, 25)), r.random()
        for k in range(count):
            long = self.words(1, r.choice((4, 30, 90, 250)))
            if r.random() < 0.1:
                long = long.replace(" ", " <em>", 1) + "</em>"
            if style < 0.65:
                parts.append(f"<p>{long}</p>" if r.random() < 0.9 else f"<p><b>{long}<br>" if r.random() < 0.5 else f"<p>{long}")
            elif style < 0.75:
                parts.append(f"{long}<br><br>")
            else:
                parts.append(f"<{(tag := r.choice(('div', 'p', 'section')))}>{long}</{tag}>")
            if r.random() < 0.08:
                parts.append(f"<h2>{self.words(1, 8)}</h2>")
            if r.random() < 0.05:
                parts.append("<ul>" + "".join(f"<li>{self.words(1, 20)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            if r.random() < 0.05:
                parts.append(f"<blockquote><p>{self.words(3, 40)}</p></blockquote>")
            if r.random() < 0.15 and k or k == count - 1 and r.random() < 0.1:
                parts.append(self.junk(r.choice(("advert", "advert", "share", "side", "notice", "form", "reader"))))
        inside = "".join(parts)
        how = r.random()
        if how < 0.45:
            return f"<article{self.name('main') if r.random() < 0.4 else ''}>{inside}</article>"
        if how < 0.6:
            return f"<main{self.name('main') if r.random() < 0.4 else ''}>{inside}</main>"
        if how < 0.7:
            return f"<table><tr><td>{inside}</td></tr></table>"
        return self.box(inside, ("div", "div", "section"), "main")

    def page(self) -> str:
        r = self.r
        some = lambda kind, p: self.junk(kind) if r.random() < p else ""
        top = [some("notice", 0.25), some("header", 0.4), some("menu", 0.8), some("advert", 0.5), some("form", 0.15)]
        middle = [some("side", 0.2), some("share", 0.15), self.article(), some("share", 0.2), some("advert", 0.25), some("side", 0.3)]
        end = [some("side", 0.2), some("reader", 0.4), some("form", 0.2), some("notice", 0.1), some("footer", 0.85)]
        if r.random() < 0.2:
            r.shuffle(top)
        if r.random() < 0.4:
            middle = [f"<div{self.name('main') if r.random() < 0.3 else ''}>" + "".join(middle) + "</div>"]
        tail = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>{self.bad(2, 9)}</title><style>p{{margin:0}}</style><script>track(\"</p>\");</script></head><body>{''.join(top + middle + end)}{tail}"


def labelled_nodes(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of one training page's nodes that are all article or all not; the rest is left out."""
    t = dom.parse(Writer(seed).page())
    n = len(t.tag)
    good, bad = np.zeros(n), np.zeros(n)
    clean = []
    for node, block, s in t.text:
        size = len(s.replace(MARK, "").strip())
        (bad if MARK in s else good)[node] += size
        clean.append((node, block, s.replace(MARK, "")))
    t.text = clean
    x, _ = dom.node_features(t)
    for i in range(n - 1, 0, -1):
        good[t.parent[i]] += good[i]
        bad[t.parent[i]] += bad[i]
    block = np.array([tag not in dom.INLINE for tag in t.tag])
    pure = block & (good + bad > 0) & (np.minimum(good, bad) <= 0.05 * (good + bad))
    return x[pure], (good > bad)[pure].astype(float)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs, ys = zip(*(labelled_nodes(s) for s in b.column("id").to_pylist()), strict=True) if b.num_rows else ((), ())
        if xs:
            x, y = np.concatenate(xs), np.concatenate(ys)
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat), pa.array(y)], ["x", "label"])


def train(spark: SparkSession, pages: int = 800, rounds: int = 36, depth: int = 5, seed: int = 7) -> Trees:
    """Boosted trees from `pages` generated pages, kept in the shared folder."""

    def fit() -> Trees:
        rows = materialize(arrow_map(spark.range(seed * 10**6, seed * 10**6 + pages, 1, 8), _training, "x array<double>, label double"), "nodes")
        return boosted(rows, rounds, depth, seed)

    return kept(spark, f"html-{pages}-{rounds}-{depth}-{seed}", fit, dom, sys.modules[__name__])


def main_text(page: str | None, trees: Trees) -> str:
    t = dom.parse(page or "")
    if not t.text:
        return ""
    x, _ = dom.node_features(t)
    return dom.chosen_text(t, dom.decode(t, trees.probability(x)))


#: Nodes that are scored at once, about: a page of more is scored by itself.
NODES = 20_000


def _scored(group: list[tuple[dom.Tree, np.ndarray]], trees: Trees) -> list[str]:
    p = np.split(trees.probability(np.concatenate([x for _, x in group])), np.cumsum([len(x) for _, x in group])[:-1])
    return [dom.chosen_text(t, dom.decode(t, q)) for (t, _), q in zip(group, p, strict=True)]


def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    trees = model.value
    for batch in batches:
        for b in slices(batch, "html"):
            text, group, nodes = [], [], 0
            for page in b.column("html"):  # one page at a time: its tree is freed once its group is scored
                t = dom.parse(page.as_py() or "")
                x = dom.node_features(t)[0]
                if group and nodes + len(x) > NODES:
                    text, group, nodes = text + _scored(group, trees), [], 0
                group.append((t, x))
                nodes += len(x)
            text += _scored(group, trees) if group else []
            names = [n for n in b.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(text, pa.string())], [*names, "text"])


def extract(pages: DataFrame, trees: Trees, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text: each page's main text, whole. Null or empty html gives ""; one row per input row."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # rounds * 2^depth nodes
    few = pages.select(*keep, F.col("html").cast("string").alias("html"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema if f.name != "html")
    return arrow_map(few, partial(_extract, model=shared), f"{kind}, text string")


def op10_html(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), train(spark))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
