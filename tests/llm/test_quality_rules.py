import collections
import random
import re

from wellcut.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)),
    }


def test_measures_against_brute_force(docs_of, odd):
    rng = random.Random(1)
    words = ["the", "a", "É", "日本", "###", "$x", "OK!", " ", " ", "b|c"]
    rows = [(100 + i, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "\x0b", "  "]) for _ in range(rng.randrange(80)))) for i in range(200)]
    got = q.ledger(docs_of(odd + rows)).collect()
    texts = collections.defaultdict(list)
    for i, t in odd + rows:
        texts[i].append(t)
    assert len(got) == len(odd) + len(rows)
    for r in got:
        want = brute(texts[r["doc_id"]][0])
        assert {k: r[k] for k in want} == want
        bits = sum(1 << i for i, rule in enumerate(q.RULES) if eval(rule.fails.replace("AND", "and").replace("OR", "or"), {}, want))  # noqa: S307
        assert r["failed"] == bits


def test_policies_and_ablations(docs_of):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (2, "short text"), (3, "$$$ " + " ".join(f"w{i}$$$" for i in range(60))), (4, good.upper()), (5, "x " * 100), (6, None), (7, "\n".join([good] + ["same line here"] * 9))]
    docs = docs_of(rows)
    ledger = q.ledger(docs)
    kept = lambda p: {r["doc_id"] for r in q.apply_policy(ledger, p).where("kept").collect()}
    assert kept("v1") == {1, 7} and kept("base") == {1, 3, 4, 7} and kept("strict-v1") == {1}
    out = q.keep(docs, "v1")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {1, 7}
    found = {r["rule"]: r for r in q.ablations(ledger, "v1").collect()}
    bits = [r["failed"] & q.mask("v1") for r in ledger.collect()]
    for i, rule in enumerate(q.RULES):
        if rule.name in q.POLICIES["v1"] and rule.name in found:
            r = found[rule.name]
            assert r["n_failed"] == sum(b >> i & 1 for b in bits) and r["n_only"] == sum(b == 1 << i for b in bits) and r["n_kept_without"] == sum(b & ~(1 << i) == 0 for b in bits)
    assert q.ledger(docs.limit(0)).count() == 0
