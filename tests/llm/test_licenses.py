"""Licence notices: bounds, edge cases and a direct computation."""

import re

from barlens.llm import licenses as lic

SCHEMA = "best string, doc_id long, text string, dice int"


def bigrams(t):
    w = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).split()
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(text):
    text = text or ""
    units = {re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), u)).strip() for u in [*text.split("\n"), text]}
    found = []
    for u in units:
        for name, ts in lic.TEMPLATES.items():
            for t in ts:
                a, b = bigrams(u), bigrams(t)
                if a and 2 * len(a & b) / (len(a) + len(b)) >= lic.LEAST_DICE - 1e-9:
                    found.append((-2 * len(a & b) / (len(a) + len(b)), name))
    best = min(found, default=(None, None))
    return len(found), sorted({n for _, n in found}), best[1], None if best[0] is None else round(-best[0], 9)


def test_against_direct(spark):
    mit = lic.TEMPLATES["MIT"][3]
    texts = [None, "", "\n\n", "Released under the MIT License.", "released  UNDER the, MIT license", "words\nReleased under the MIT License.\nmore", mit, mit.replace("free", "gratis"),
             "intro\n" + mit + "\nend", "\n".join(mit.split(", ")), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0", "the the the the",
             "a b " * 30_000, "w " + " ".join(f"w{i}" for i in range(30_000)), "Released under the MIT License. " * 500, "İ K Released under the MIT License é"] + [t for ts in lic.TEMPLATES.values() for t in ts]
    df = spark.createDataFrame([("x", i, t, 1) for i, t in enumerate(texts)] + [("x", None, texts[3], 1)] * 2, SCHEMA)
    rows = lic.licence_hits(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        got = (r.n_hits, r.licences, r.best, None if r.best_dice is None else round(r.best_dice, 9))
        assert got == brute(texts[r.doc_id if r.doc_id is not None else 3]), texts[r.doc_id or 3][:80]
    assert lic.licence_hits(df.limit(0)).collect() == [] and {r.n_hits for r in lic.licence_hits(df, {}).collect()} == {0}


def test_size_bounds():
    for n in range(1, 60):
        lo, hi = lic.size_bounds(n, 0.8)
        for m in range(1, 200):
            assert (2 * min(m, n) / (m + n) >= 0.8 - 1e-9) == (lo <= m <= hi)


def test_native(spark, sf):
    plan = lic.op6_licences(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def best_run(text, template, least=lic.LEAST_DICE):
    """Largest coefficient of any run of words, sliding over the text."""
    w = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    b, pairs = bigrams(template), list(zip(w, w[1:]))
    most = lic.size_bounds(len(b), least)[1] + len(lic.words_of(template)) - 1 - len(b)
    found = 0.0
    for i in range(len(pairs)):
        seen = set()
        for x in pairs[i:i + most]:
            seen.add(x)
            found = max(found, 2 * len(seen & b) / (max(len(seen), len(b)) + len(b)))
    return found if found >= least - 1e-9 else 0.0


def test_runs_against_sliding(spark):
    """Notices that are wrapped or stand within a line of a longer text."""
    prose = " ".join("lorem%d the software of the" % (i % 37) for i in range(60))

    def wrapped(t, n, lead=""):
        w = t.split()
        return "\n".join(lead + " ".join(w[i:i + n]) for i in range(0, len(w), n))
    every = [(name, t) for d in (lic.TEMPLATES, lic.TEXTS) for name, ts in d.items() for t in ts]
    texts = []
    for _, t in every:
        texts += [f"{prose}\n{wrapped(t, 9, ' * ')}\n{prose}", f"{prose} {t} {prose}"]
    gpl = lic.TEMPLATES["GPL-3.0"][2]
    texts += [f"{prose} {gpl.replace('redistribute it', 'share that')} {prose}", f"{prose} {' '.join(gpl.split()[:12])} {prose}", f"{prose}\n{wrapped(gpl, 3)} {prose} {wrapped(lic.TEXTS['ISC'][0], 11)}",
              f"{prose} Released under the\nMIT Licence {prose}", prose, f"{prose} the mit license {prose}", "\n".join(f"{prose} Licensed under\n\n CC BY 4.0." for _ in range(3))]
    df = spark.createDataFrame([("x", i, t, 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    for r in lic.licence_hits(df).collect():
        t = texts[r.doc_id]
        lines = {}
        n_lines, names, best, dice = brute(t)
        for u in [*t.split("\n"), t]:
            for name, ts in lic.TEMPLATES.items():
                a = bigrams(u)
                d = max((2 * len(a & bigrams(x)) / (len(a) + len(bigrams(x))) for x in ts), default=0)
                lines[name] = max(lines.get(name, 0), d if d >= lic.LEAST_DICE - 1e-9 else 0)
        runs = [(name, d) for name, x in every if (d := best_run(t, x)) > lines.get(name, 0) + 1e-9]
        assert r.licences == sorted({n for n, _ in runs} | set(names)), (r, runs, t[-300:])
        free = [x for x in runs if not lines.get(x[0])]  # runs of an identifier that a line reaches too count if they go over a line end
        assert n_lines + len(free) <= r.n_hits <= n_lines + len(runs), (r, runs)
        if len(free) == len(runs):
            assert round(r.best_dice or 0, 9) == round(max([d for _, d in runs] + [dice or 0]), 9)
    hits = {r.doc_id: r for r in lic.licence_hits(df).collect()}
    for i, (name, _) in enumerate(every):
        assert {name} <= set(hits[2 * i].licences) and {name} <= set(hits[2 * i + 1].licences)
        assert abs(hits[2 * i].best_dice - 1) < 1e-9 and abs(hits[2 * i + 1].best_dice - 1) < 1e-9


def test_gate_words():
    """No set of bigrams that reaches a template is without all of the words."""
    sets = [lic.template_bigrams(t) for d in (lic.TEMPLATES, lic.TEXTS) for ts in d.values() for t in ts]
    words = set(lic.gate_words(sets, 0.8))
    assert all(sum(not words & set(x.split()) for x in b) < lic.least_common(len(b), 0.8) for b in sets)
