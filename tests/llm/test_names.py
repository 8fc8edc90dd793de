import itertools
import random

import pytest

from tidemark.llm import name_parts as parts
from tidemark.llm import name_variants as nv
from tidemark.llm.components import components


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def is_typing_error(a, b):
    e, both = edits(a, b), min(len(a), len(b))
    return both >= 5 and (e <= 1 or e == 2 and (both >= 8 or sorted(a) == sorted(b)))


@pytest.mark.parametrize("seed", [1, 2])
def test_segment_join_finds_all_near_forms(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    words = set(base)
    for w in base:
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(x)) if x else 0
                x[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "a", "b", "ab"])
            words.add("".join(x))
            at = rng.randrange(len(w) - 1)
            words.add(w[:at] + w[at + 1] + w[at] + w[at + 2 :])
    words = sorted(words)
    got = {(r.a, r.b): r.edits for r in nv.near_forms(spark.createDataFrame([(w,) for w in words] + [(None,), (words[0],)], "w string"), "w").collect()}
    want = {(a, b): edits(a, b) for a, b in itertools.combinations(words, 2) if is_typing_error(a, b)}
    assert got == want
    tagged = spark.createDataFrame([(w, "x" if i % 3 else "y") for i, w in enumerate(words)], "w string, same string")
    kind = {w: "x" if i % 3 else "y" for i, w in enumerate(words)}
    got = {(r.a, r.b) for r in nv.near_forms(tagged, "w", "same").collect()}
    assert got == {(a, b) for a, b in want if kind[a] == kind[b]}


def test_tokens():
    assert parts.tokens("STIM-AEHEGOR ENGINEERING, THERMAL") == ["stimaehegor", "engineering", "thermal"]
    assert parts.tokens("Stöwámébüs Medical Tech") == ["stowamebus", "medical", "tech"]
    assert parts.tokens("Vak0laeror P.T., L.L.C. - Site 4") == ["vakolaeror", "pt", "llc"]
    assert parts.tokens("DrapOrtis_Works Limited Liability Company #2") == ["drap", "ortis", "works", "llc"]
    assert parts.tokens("") == [] and parts.tokens("  ") == []


def test_placeholders():
    for x in (None, "", " ", "-NONE-", "N/A", "Unknown", "MULTIPLE RECIPIENTS"):
        assert parts.is_placeholder(x)
    assert not parts.is_placeholder("Nona Works")


def test_abbreviations_and_cover():
    assert parts.abbreviates("mgmt", "management") and parts.abbreviates("labies", "laboratories")
    assert not parts.abbreviates("mgmt", "manufacturing") and not parts.abbreviates("m", "management")
    assert parts.fits([], ["=p", "=t"], ["payload", "technologies"])
    assert not parts.fits([], ["=p", "=p"], ["payload", "technologies"])
    assert parts.fits(["payload"], ["group|works"], ["payload", "works"])
    assert not parts.fits(["railway", "holdings"], [], ["railway", "development"])
    assert parts.fits([], ["alexander|sandra"], ["alexander", "n."])


NAMES = {
    "a": ["STUGEWIZEL PAYLOAD TECHNOLOGIES CORP", "Stugewizel Payload Technologies", "stgewizel payload technologies", "Stugewizel P.T. Corp", "TECHNOLOGIES (STUGEWIZEL) PAYLOAD", "Stügéwízel Payload Techs, Corporation", "STUGEWIZELPAYLOAD TECHNOLOGIES"],
    "b": ["DREHOFILAN RAILWAY HOLDINGS CORP", "Drehofilan Railway Hldgs", "Drehofilan Holdings, Railway"],
    "c": ["DREHOFILAN RAILWAY DEVELOPMENT CORP", "Drehofilan Railway Dvlpmt Corporation"],
    "d": ["Robert H. Behaenenel", "BEHAENENEL, ROBERT H", "Bob Behaenenel", "R. Behaenenel"],
    "e": ["Frederick Behaenenel"],
    "f": ["Drehofilan Railway"],  # either of two sisters
}
FILLER = [f"{stem} {field} {kind} Inc" for i, stem in enumerate(["Kobalentis", "Mirupadel", "Vosikanor", "Tebrulizan", "Gafemodul", "Pelutirak"]) for field in ("Payload", "Railway") for kind in ("Technologies", "Holdings", "Development", "Management")]


def test_links(spark):
    rows = [(n,) for ns in NAMES.values() for n in ns] + [(n,) for n in FILLER] + [(None,), ("",), ("UNKNOWN",), ("N/A",), ("The Co",), ("x" * 50000,), (NAMES["a"][0],)]
    out = nv.link_names(spark.createDataFrame(rows, "NAME string"), "NAME").collect()
    got = {r.name: r.class_id for r in out}
    assert len(got) == len(out) and not {None, "", "UNKNOWN", "N/A"} & got.keys()
    classes = {k: {got[n] for n in ns} for k, ns in NAMES.items()}
    assert all(len(c) == 1 for c in classes.values()), classes
    assert len(set.union(*classes.values())) == len(classes)
    assert not {got[n] for n in FILLER} & set.union(*classes.values())
    path = {r.name: r.path for r in out}
    assert path["stgewizel payload technologies"] == "near" and path["Drehofilan Railway Hldgs"] == "form" and path["Stugewizel P.T. Corp"] == "shortened"


def test_one_organisation_with_a_third_of_the_names(spark):
    rng = random.Random(4)

    def mistyped(w):
        at = rng.randrange(1, len(w))
        return w[:at] + rng.choice("aeiourstln") + w[at + rng.choice([0, 1]) :]

    heavy = {"Vostrumelik", "Vostrumelik Textile", "Vostrumelik Textile Grp", "Vostrumelik Txtl Group Co", "Vostrumelik Textile Group Co", "Textile Vostrumelik Group"}
    while len(heavy) < 100:
        w = ["Vostrumelik", "Textile", "Group"]
        for i in rng.sample(range(1, 3), rng.choice([1, 2])):
            w[i] = mistyped(w[i])
        heavy.add(" ".join(w) + rng.choice(["", " Co", " Inc", " Ltd"]))
    stems = ["Kobalentis", "Mirupadel", "Dazikanor", "Tebrulizan", "Gafemodul", "Pelutirak", "Shurogimen", "Wandelopi"]
    rest = [f"{s} {f} {k}{e}" for s in stems for f in ("Textile", "Ordnance") for k in ("Group", "Grp", "Holdings", "Hldgs") for e in ("", " Co", " Inc")]
    got = {r.name: r.class_id for r in nv.link_names(spark.createDataFrame([(n,) for n in sorted(heavy) + rest], "n string"), "n").collect()}
    classes = [got[n] for n in heavy]
    main = max(set(classes), key=classes.count)
    assert {got[n] for n in ("Vostrumelik", "Vostrumelik Textile", "Vostrumelik Textile Grp", "Vostrumelik Txtl Group Co", "Textile Vostrumelik Group")} == {main}
    assert classes.count(main) >= 0.9 * len(heavy)
    assert main not in {got[n] for n in rest}
    assert len({got[f"{s} Ordnance Group"] for s in stems}) == len(stems)  # a general word that no vocabulary has
    assert all(got[f"{s} Ordnance Group"] == got[f"{s} Ordnance Grp Co"] for s in stems)


def test_pairs_and_empty(spark, rows):
    linked = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1), ("z", 2)], "name string, class_id int")
    assert rows(nv.pairs(linked)) == rows(nv.pairs(linked, block=1)) == [("a", "b"), ("a", "c"), ("b", "c")]
    many = spark.createDataFrame([(f"n{i:03}", 1) for i in range(100)], "name string, class_id int")
    assert nv.pairs(many, block=7).distinct().count() == nv.pairs(many, block=7).count() == 4950
    assert nv.link_names(spark.createDataFrame([], "n string"), "n").count() == 0


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(60)]
    rest = [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    edges = chain + rest + [(200, 200), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {n: n for e in edges for n in e if n is not None}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None:
                m = min(root[a], root[b])
                changed |= root[a] != m or root[b] != m
                root[a] = root[b] = m
    root.pop(3) if 3 not in got else None
    assert got == root
