"""Template decontamination: brute force over all windows, re-parameterised items, odd inputs."""

from flowspark.llm import decontaminate as d

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"
ITEMS = [
    (1, "A train leaves Paris at 9:30 and travels 120 km toward Lyon where Marie waits for 45 minutes before she walks home.", "x"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "x"), (3, "Only five short words here.", "x"), (4, None, "x"), (5, "1 2 3 4 5 6 7 8 9 10", "x"),
]


def found(spark, docs, items=ITEMS, **kw):
    out = d.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), **kw)
    return {(r.doc_id, r.item_id): r.kind for r in out.collect()}


def test_verbatim_reparameterised_and_inconsistent(spark):
    rest = " plain words stand around it in every case."
    docs = [
        (1, "Before. " + ITEMS[0][1] + rest, None),
        (2, "Before. A train leaves Rome at 8:15 and travels 300 miles toward Milan where Anna waits for 20 minutes before she walks home." + rest, None),
        (3, "A bus stops in Paris at 9:30 and leaves 120 people." + rest, None), (4, None, None), (5, "", None),
        (6, "x " * 40000 + " ".join(ITEMS[1][1].upper().split()), None), (7, "say only five short words here, please", None), (8, "7 7 7 7 7 7 7 7 7 7 7", None),
        (None, ITEMS[1][1], None), (9, "iota kappa lambda mu nu xi omicron pi rho sigma", None), (6, "second row of six", None),
    ]
    assert found(spark, docs) == {(1, 1): "verbatim", (2, 1): "reparameterised", (6, 2): "verbatim", (7, 3): "verbatim", (None, 2): "verbatim"}
    left = d.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(ITEMS, ITEM))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 8, 9] and left.columns == ["doc_id", "text", "item_id"]


def test_slots_must_agree(spark):
    item = [(1, "take 3 red apples and put 3 more apples beside the same 3 pears near 3 plums now", "x")]
    same = "take 5 red apples and put 5 more apples beside the same 5 pears near 5 plums now"
    mixed = "take 5 red apples and put 6 more apples beside the same 7 pears near 8 plums now"
    assert found(spark, [(1, same, None), (2, mixed, None)], item) == {(1, 1): "reparameterised"}


def test_each_occurrence_counts(spark):
    """A sheet of variants of an item, each consistent by itself; one with a word put in, one whose halves stand apart."""
    said = "A train leaves {} at {} and travels {} km toward {} where {} waits for {} minutes before she walks home."
    odd = said.replace("km toward", "km then slowly on toward")
    a, b, c = ("Paris", "9:30", "120", "Lyon", "Marie", "45"), ("Rome", "8:15", "300", "Milan", "Anna", "20"), ("Bonn", "7:10", "80", "Mainz", "Petra", "15")
    rest = " other words stand here between the two of them, and there are quite enough of these."
    words = said.format(*a).split()
    docs = [
        (1, said.format(*a) + " " + said.format(*b), None), (2, " ".join(said.format(*x) for x in (b, c, b[:2] + c[2:])), None),
        (3, odd.format(*b) + rest + " " + odd.format(*c), None), (4, " ".join(words[:13]) + rest + " " + " ".join(words[9:]), None),
    ]
    assert found(spark, docs, ITEMS[:1]) == {(1, 1): "verbatim", (2, 1): "reparameterised", (3, 1): "reparameterised", (4, 1): "verbatim"}


def test_items_of_few_ordinary_words(spark):
    """Copies of numbers, names and short questions are found as they stand, and nothing else of them."""
    items = [(1, "1 2 3 4 5 6 7 8 9 10", "x"), (2, "What is 12 * 7 + 5?", "x"), (3, "List: Anna Berta Clara Dora Emma Frida Greta Hanna Ida Jana", "x"), (4, "Take the old red cart to town by noon for 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "x")]
    docs = [(1, "so 1 2 3 4 5 6 7 8 9 10 they say", None), (2, "1 2 3 4 9 9 9 5 6 7 8 9 10", None), (3, "Tell me: what is 12 * 7 + 5?", None), (4, "What is 13 * 7 + 5?", None), (5, "the list: Anna Berta Clara Dora Emma Frida Greta Hanna Ida Jana", None), (6, "the list: Anna Berta Carla Dora Emma Frida Grete Hanna Ida Jana", None), (7, "take the old red cart to town by noon for 9 8 7 6 and no more", None)]
    assert found(spark, docs, items) == {(1, 1): "verbatim", (3, 2): "verbatim", (5, 3): "verbatim", (7, 4): "reparameterised"}


def test_coverage_against_brute_force(spark):
    import random

    rng = random.Random(3)
    vocab = [f"w{i}x" for i in range(40)]
    vocab = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in v) for v in vocab]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(9, 30))), "x") for i in range(20)]
    docs = [(i, " ".join(w for _, t, _ in rng.sample(items, 2) for w in (t.split()[: rng.randrange(30)] + [rng.choice(vocab)])), None) for i in range(60)]
    got = {(r.doc_id, r.item_id): r.windows for r in d.contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    grams = lambda t: [tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)]
    want = {}
    for i, t, _ in docs:
        have = set(grams(t))
        for j, s, _ in items:
            if n := sum(g in have for g in grams(s)):
                want[i, j] = n
    assert got == want


def test_empty_tables(spark):
    assert found(spark, []) == {} and found(spark, [(1, ITEMS[1][1], None)], []) == {}
