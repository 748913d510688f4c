"""The pipeline stage by stage, and HTML extraction, against versions that share no code with them but what is named."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from tessera.llm import bpe, html, language, lines, simhash

from test_operators import corpus, table


def linked(items, near):
    label = {d: d for d, _ in items}
    changed = True
    while changed:
        changed = False
        for i, (a, x) in enumerate(items):
            for b, y in items[:i]:
                if label[a] != label[b] and near(x, y):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def told(rows, docs):
    """Rows that the classifier (its fit and its margin are the operator's own) tells."""
    fitted, margin = language.learn(docs)
    c = language.Classifier(fitted)
    return [r for r in rows if not c.predict(r[1], margin)[3]]


def without_lines(rows):
    clean = lambda t: [x.strip(" \t\n\r\x0b\x0c") for x in (t or "").split("\n")]
    out = []
    for d, t, lang, s, n in rows:
        gone = set()
        if d is not None:
            mine = clean(t)
            for e, u, *_ in rows:
                if e is not None and e < d:
                    gone |= set(lines.common_lines(mine, clean(u), [len(x) for x in mine]))
        if gone:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            n = len(t)
            if not t.strip(" \t\n\r\x0b\x0c"):
                continue
        out.append((d, t, lang, s, n))
    return out


def one_of_each(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    items = [(r[0], (simhash.fingerprint(r[1], 5), shingles(r[1]))) for r in rows if r[0] is not None]
    label = linked(items, lambda x, y: (x[0] ^ y[0]).bit_count() <= 2 or len(x[1] & y[1]) >= 0.8 * len(x[1] | y[1]))
    return [r for r in rows if r[0] is None or label[r[0]] == r[0]]


def mixed(rows):
    size = [len((r[1] or "").split()) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(total.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    out = []
    for s in order:
        base = math.floor(target[s] / total[s]) if total[s] else 0
        mine = [(hashlib.md5(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest(), n, r) for r, n in zip(rows, size, strict=True) if r[3] == s]
        for h, n, r in mine:
            before = sum(m for g, m, _ in mine if (g, m) <= (h, n))
            more = base < 2 and before - n / 2 <= target[s] - base * total[s]
            out += [r] * (base + more)
    return out


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    table(spark, corpus(60, 3)).select(names).write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in d.collect()]
    sort = lambda x: sorted(map(repr, x))
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:-1], (lambda x: told(x, d), without_lines, one_of_each, mixed), strict=True):
        rows = brute(rows)
        out = stage(spark, d, str(tmp_path))
        assert out.columns == names and rows
        found = out.collect()
        assert sort(map(tuple, found)) == sort(rows)
        d = spark.createDataFrame(found, d.schema)
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:4]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_pipeline_on_no_rows(spark):
    import corpus_pipeline

    d = table(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, "").count() == 0


def page(rnd, made):
    """A page of random trees, and the words of it that show, in order."""
    out, shown = [], []

    def word(seen):
        w = f"w{len(made)}"
        made.append(w)
        if seen:
            shown.append(w)
        return w

    def inline(seen):
        kind = rnd.randrange(7)
        if kind == 0:
            return f" <b>{word(seen)}</b> "
        if kind == 1:
            return f" <span hidden>{word(False)}</span> "
        if kind == 2:
            return f" <!-- {word(False)} > {word(False)} --> "
        if kind == 3:
            return f" <a href='x>y'>{word(seen)}</a> &amp; "
        return f" {word(seen)} "

    def block(depth, seen):
        kind = rnd.randrange(12 if depth < 5 else 3)
        if kind < 3:
            return f"<p>{''.join(inline(seen) for _ in range(rnd.randint(1, 4)))}" + ("</p>" if rnd.random() < 0.5 else "")
        if kind == 3:
            return f"<div style='color:red; display : none'>{block(depth + 1, False)}</div>"
        if kind == 4:
            return f"<script>if (a<b) '{word(False)}'</script><style>{word(False)}</style>"
        if kind == 5:
            return f"<ul>{''.join('<li>' + inline(seen) + (block(depth + 1, seen) if rnd.random() < 0.3 else '') for _ in range(3))}</ul>"
        if kind == 6:
            return f"<table>{''.join('<tr>' + ''.join('<td>' + inline(seen) for _ in range(2)) for _ in range(2))}</table>"
        if kind == 7:
            return f"<h2>{inline(seen)}</h2><blockquote>{block(depth + 1, seen)}</blockquote>"
        if kind == 8:
            return f"<details><summary>{inline(seen)}</summary>{block(depth + 1, False)}</details>"
        if kind == 9:
            return f"<pre>{inline(seen)}\n  {inline(seen)}</pre><template>{word(False)}</template>"
        return f"<div>{block(depth + 1, seen)}{block(depth + 1, seen)}</div>"

    for _ in range(rnd.randint(1, 6)):
        out.append(block(0, True))
    return f"<html><head><title>{word(False)}</title><body>{''.join(out)}", shown


def test_html_shows_what_is_visible():
    rnd = random.Random(11)
    for _ in range(400):
        source, shown = page(rnd, [])
        got = [w for w in html.extract(source).split() if w[0] == "w"]
        assert got == shown, source
