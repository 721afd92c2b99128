import random

import pytest

from semspark.llm.subjects import SubjectGraph, sentences

LEXICON = {"law": ["contract", "clause", "court", "notary", "treaty"], "sport": ["goalkeeper", "stadium", "referee", "league", "sprint"], "science": ["telescope", "isotope", "reagent", "genome", "laser"]}
VERBS = {"law": "binds the reseller", "sport": "won the final match", "science": "deviates by 3 standard errors"}
FILLER = ["Details follow below.", "Thanks to everyone who joined.", "Item 4 is closed.", "The list is kept as agreed."]
DOCS, LABELS = "doc_id long, text string, form long, n int, subject string", "doc_id long, subject string, text string"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels, truth = [], [], set()
    for i in range(n):
        own = rng.sample(list(LEXICON), rng.choice([0, 1, 1, 2]))
        lines = []
        for s in own:
            for _ in range(4):
                noun = rng.choice(LEXICON[s])
                lines.append(rng.choice([f"The {noun} {VERBS[s]}.", f"The {noun} is the main topic of this note.", f"The whole thing {VERBS[s]}."]))
            truth.add((i, s))
            if rng.random() < 0.3:
                labels.append((i, s.upper() if rng.random() < 0.2 else f" {s} "))
        lines += [rng.choice(FILLER) for _ in range(3)]
        if not own or rng.random() < 0.3:
            other = rng.choice([s for s in LEXICON if s not in own])
            lines.append(f"Somebody also mentioned the {rng.choice(LEXICON[other])}, but it was not discussed.")
        rng.shuffle(lines)
        docs.append((i, "# HEADING 3\n" + "\n".join("- " + x for x in lines)))
    return docs, labels, truth


def found(spark, docs, labels, subjects=tuple(sorted(LEXICON))):
    d = spark.createDataFrame([(*r, 1, 1, "clash") for r in docs], DOCS)
    lab = spark.createDataFrame([(*r, "clash") for r in labels], LABELS)
    return {(r.doc_id, r.subject) for r in SubjectGraph(d, lab, list(subjects)).document_shares().filter("share >= 0.25").collect()}


def test_unlabelled_documents_get_their_subjects(spark):
    docs, labels, truth = corpus()
    odd = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "# only a heading"), docs[0], (9005, "Details follow below. " * 20_000)]
    got = found(spark, docs + odd, labels + labels[:3] + [(1, "unknown"), (None, "law"), (77_777, "law"), (2, None)])
    held = truth - {(i, s.strip().lower()) for i, s in labels}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    assert len(got & held) >= 0.93 * len(held)
    assert not {i for i, _ in got} & {9001, 9002, 9003, 9004, 9005}


def test_without_seeds_or_documents(spark):
    docs, labels, _ = corpus(20)
    assert found(spark, docs, []) == set()
    assert found(spark, [], labels) == set()
    assert found(spark, docs, labels, ("law",)) <= {(i, "law") for i, _ in docs}


def test_sentences_of_odd_texts():
    text = "TICKET-12\nstate: open\n\n1. One  thing&nbsp;is done. Two ORG_2001 stay\nopen.\n[12:30] analyst_a: 第 3 项已关闭。以上为初步结果。\npage 1 / 2\n```sql\nSELECT 1.\n```\n(sent by a robot)"
    assert sentences(text) == ["one thing is done.", "two stay open.", "第 0 项已关闭。", "以上为初步结果。"]
    assert sentences("") == [] and sentences("--\n# x\n| a |") == []


def word(rng):
    return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))


def made_up(subjects, n, seed):
    """Documents whose words, predicates, filler and words of passing mention are all made up."""
    rng = random.Random(seed)
    nouns = {s: [word(rng) for _ in range(5)] for s in subjects}
    acts = {s: [f"{word(rng)} {word(rng)}" for _ in range(3)] for s in subjects}
    filler, aside = [f"{word(rng)} {word(rng)} {word(rng)}." for _ in range(6)], (word(rng), word(rng), word(rng))
    docs, labels, truth = [], [], set()
    for i in range(n):
        own = rng.sample(subjects, rng.choice([1, 1, 2]))
        lines = [f"{rng.choice(nouns[s])} {rng.choice(acts[s])} {word(rng)}." for s in own for _ in range(4)] + rng.sample(filler, 2)
        truth |= {(i, s) for s in own}
        labels += [(i, s) for s in own if rng.random() < 0.5]
        if rng.random() < 0.5:
            lines.append(f"{aside[0]} {aside[1]} {rng.choice(nouns[rng.choice([s for s in subjects if s not in own])])} {aside[2]}.")
        if i % 40 == 0:
            labels.append((i, rng.choice([s for s in subjects if s not in own])))  # a wrong label
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    return docs, labels, truth


def good(got, truth):
    return len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_unseen_words_and_templates_and_wrong_labels(spark):
    docs, labels, truth = made_up(["aa", "bb", "cc", "dd"], 500, 3)
    d, lab = spark.createDataFrame([(*r, 1, 1, "clash") for r in docs], DOCS), spark.createDataFrame([(*r, "clash") for r in labels], LABELS)
    g = SubjectGraph(d, lab, ["aa", "bb", "cc", "dd"])
    got = {(r.doc_id, r.subject) for r in g.document_shares().filter("share >= 0.25").collect()}
    assert good(got, truth)
    seeds = {(r.doc_id, r.subject): r.trusted for r in g.seeds().collect()}
    assert set(seeds) == set(labels)
    assert {k for k, t in seeds.items() if t} <= got  # trusted seeds are clamped
    wrong = {k for k in seeds if k not in truth}
    assert wrong and sum(seeds[k] for k in wrong) <= 0.2 * len(wrong) and sum(t for k, t in seeds.items() if k in truth) >= 0.9 * (len(seeds) - len(wrong))


def test_many_subjects(spark):
    subjects = [f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    docs, labels, truth = made_up(subjects, 2400, 5)
    assert good(found(spark, docs, labels, tuple(subjects)), truth)
    with pytest.raises(ValueError):
        SubjectGraph(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS), [str(i) for i in range(1001)])
