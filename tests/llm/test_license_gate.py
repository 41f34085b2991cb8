import random
import textwrap

import regex
from pyspark.sql import functions as F

from wellcut.llm import licenses

COMMON = ["the house released a note", "a permit for boats", "no license here", "he went under water", "an old public library"]
# paragraphs as software has them: every word of the notices is common
SOFTWARE = ["the license of the project is distributed under version 2", "released under the terms of the gnu build", "mit license terms apply to this program", "apache version 2 is licensed software"]


def unknown(lines):
    known, out = set(licenses.feature_names()), {}
    for x in lines:
        k = tuple(sorted(set(licenses.grams(licenses.words(x))) & known))
        out[k] = out.get(k, 0) + 1
    return out


def test_no_paragraph_that_a_notice_confirms_lacks_a_cue():
    for lines in ([], COMMON * 300, SOFTWARE * 300):
        cues = set(licenses.fit(unknown(lines), variants=2, rounds=2).cues)
        for _, n in licenses.all_notices():
            assert len(set(n) - cues) / len(set(n)) < licenses.Model.overlap


def test_notice_of_common_words_is_found(docs_of):
    for lines in (COMMON, SOFTWARE):
        docs = docs_of([(i, lines[i % len(lines)]) for i in range(400)] + [(1000, "Released under the MIT License."), (1001, "This project is distributed under the terms of the MIT license.\nThe house."), (1002, "the house")])
        got = {r["doc_id"]: [x["family"] for x in r["licenses"]] for r in licenses.scan(docs, licenses.train(docs)).collect()}
        assert got.pop(1000) == ["mit"] and got.pop(1001) == ["mit"] and not any(got.values())


def test_wrapped_notices_are_found(docs_of):
    rows, want = [], []
    for f, xs in licenses.NOTICES.items():
        for x in xs:
            for prefix in ("", "# ", " * "):
                wrapped = textwrap.fill(x, 32, initial_indent=prefix, subsequent_indent=prefix)
                rows.append((len(rows), f"A title\n\n{wrapped}\n\n{prefix}\nThe house went on.\nAnd on."))
                want.append(f)
    rows.append((len(rows), "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0\nimport this"))
    docs = docs_of(rows)
    got = {r["doc_id"]: [x["family"] for x in r["licenses"]] for r in licenses.scan(docs, licenses.train(docs_of([(i, COMMON[i % 5]) for i in range(50)]))).collect()}
    assert sorted(got.pop(len(want))) == ["apache", "mit"]
    assert sum(got[i] == [f] for i, f in enumerate(want)) >= 0.97 * len(want) and all(f in got[i] for i, f in enumerate(want))


def test_expressions_score_as_the_model_does(docs_of):
    rng = random.Random(3)
    model = licenses.fit(unknown(COMMON * 40 + SOFTWARE * 40))
    every = [w for _, n in licenses.all_notices() for w in n] + ["house", "é", "x"]
    texts = [x for xs in licenses.NOTICES.values() for x in xs] + [" ".join(rng.choice(every) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    rows = docs_of(list(enumerate(texts))).select("doc_id", licenses._scored(F.lower("text"), model).alias("s"), licenses._near_notice(F.lower("text"), 0.6).alias("near")).collect()
    for r in rows:
        family, probability, overlap = model.score(texts[r["doc_id"]])
        assert r["s"]["family"] == family and abs(r["s"]["probability"] - probability) < 1e-9 and abs(r["s"]["overlap"] - overlap) < 1e-12
        ws = licenses.words(texts[r["doc_id"]])
        assert r["near"] == (max(licenses.containment(ws, f, n) for f, n in licenses.all_notices()) >= 0.6)


def test_scan_against_plain_loops(docs_of, odd):
    """Every paragraph and line scored by the numpy model, without gates."""
    model = licenses.fit(unknown(COMMON * 40 + SOFTWARE * 40))
    rng = random.Random(8)
    lines = [*COMMON, *SOFTWARE, *(x for xs in licenses.NOTICES.values() for x in xs), "", "Mixed up.", "# ", "All rights", "reserved."]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(odd)]

    def confirmed(x):
        f, p, o = model.score(x)
        return [f] if f != licenses.UNKNOWN and p >= model.least and o >= model.overlap else []

    for r in licenses.scan(docs_of(rows), model).collect():
        text = dict(rows)[r["doc_id"]] or ""
        paragraphs = [p for p in regex.split(licenses.PARAGRAPH, text) if p.split()]
        want = []
        for p in paragraphs:
            whole = confirmed(p)
            want += whole + [f for x in p.split("\n") if x.split() for f in confirmed(x) if f not in whole]
        assert (r["n_paragraphs"], [x["family"] for x in r["licenses"]], r["n_licenses"]) == (len(paragraphs), want, len(want))
