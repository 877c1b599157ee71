import random

from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import line_dedup

SPACE = " \t\r\x0b\x0c"


def slow(texts, min_line, min_block):
    """The same rule, document by document, over the texts themselves."""
    lines = [[x.strip(SPACE) for x in t.split("\n")] for t in texts]
    owner = {}
    for d, ls in enumerate(lines):
        for x in ls:
            owner.setdefault(x, d)
    out = []
    for d, ls in enumerate(lines):
        gone, owners = set(), set()
        for o in sorted({owner[x] for x in ls if x} - {d}):
            mine = {x for x in ls if x and owner[x] == o}
            seeds = sorted((ls.index(x), lines[o].index(x)) for x in mine
                           if ls.count(x) == 1 and lines[o].count(x) == 1 and len(x) >= min_line)
            best = [[] for _ in seeds]
            for i, (_, e) in enumerate(seeds):
                before = [best[j] for j in range(i) if seeds[j][1] < e]
                best[i] = max(before, key=len, default=[]) + [seeds[i]]
            size = max(map(len, best), default=0)
            # Among longest chains: the one that patience sorting ends with.
            chain = line_dedup._increasing(seeds)
            assert len(chain) == size
            pairs = []
            for k, (l, e) in enumerate(chain):
                low = pairs[-1] if pairs else (-1, -1)
                if low[0] >= e or low[1] >= l:
                    continue
                back, a, b = [], e - 1, l - 1
                while a > low[0] and b > low[1] and ls[b] in mine and lines[o][a] == ls[b]:
                    back.insert(0, (a, b))
                    a, b = a - 1, b - 1
                pairs += [*back, (e, l)]
                nl, ne = chain[k + 1] if k + 1 < len(chain) else (len(ls), len(lines[o]))
                a, b = e + 1, l + 1
                while a < ne and b < nl and ls[b] in mine and lines[o][a] == ls[b]:
                    pairs.append((a, b))
                    a, b = a + 1, b + 1
            blocks = []
            for a, b in pairs:
                if blocks and blocks[-1][-1] == (a - 1, b - 1):
                    blocks[-1].append((a, b))
                else:
                    blocks.append([(a, b)])
            for block in blocks:
                if sum(len(ls[b]) for _, b in block) >= min_block:
                    gone.update(b for _, b in block)
                    owners.add(o)
        raw = texts[d].split("\n")
        out.append(("\n".join(x for i, x in enumerate(raw) if i not in gone), len(gone),
                    sorted(owners)))
    return out


def texts(seed, n=80):
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(1, 9))) for _ in range(60)]
    out = []
    for _ in range(n):
        ls = [r.choice(pool) for _ in range(r.randint(0, 12))]
        if out and r.random() < 0.6:
            other = r.choice(out).split("\n")
            a = r.randrange(len(other))
            ls[r.randint(0, len(ls)):0] = other[a:a + r.randint(1, 8)]
        ls = [x + r.choice(["", " ", "\t"]) for x in ls]
        out.append("\n".join(ls))
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        some = texts(seed)
        rows = line_dedup.report(documents(spark, some), min_line=8, min_block=20).collect()
        found = [(r["text"], r["gone_lines"], r["owners"])
                 for r in sorted(rows, key=lambda r: r["doc_id"])]
        assert found == slow(some, 8, 20)


def test_moved_blocks_are_not_chained():
    """Patience keeps the longest run in order; a block moved before it stays."""
    pairs = [(0, 3, True), (1, 4, True), (2, 5, True), (3, 0, True), (4, 1, True)]
    assert line_dedup.aligned(pairs) == [(0, 3), (1, 4), (2, 5)]


def test_a_line_that_everybody_holds(spark):
    line = "this very common line stands in every document of the corpus, word for word, always here, you see"
    some = [f"own beginning of text {i}\n{line}\nown end {i}" for i in range(300)]
    rows = sorted(line_dedup.report(documents(spark, some)).collect(), key=lambda r: r["doc_id"])
    assert len(line) < 100 and all(r["gone_lines"] == 0 for r in rows)
    rows = sorted(line_dedup.report(documents(spark, some), min_block=90).collect(),
                  key=lambda r: r["doc_id"])
    assert rows[0]["text"] == some[0]
    assert all(r["text"] == f"own beginning of text {i}\nown end {i}" and r["owners"] == [0]
               for i, r in enumerate(rows) if i)


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    clean = line_dedup.dedup_lines(docs)
    assert clean.schema == docs.schema
    # Rows 3 and 5 repeat id and text; nothing is long enough to be a copied block.
    assert sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    passage = "\n".join(f"line {i} of a passage that is held by two" for i in range(5))
    two = documents(spark, [passage, passage, passage, "other\n" + passage], [5, 5, 6, None])
    left = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(two).collect())
    assert left == [(0, "other\n" + passage), (5, passage), (5, passage), (6, "")]


def held_anywhere(texts, min_block):
    """Lines of each text in a run of enough characters that any earlier text holds in one
    piece, by all pairs and all diagonals."""
    lines = [[x.strip(SPACE) for x in t.split("\n")] for t in texts]
    out = []
    for d, late in enumerate(lines):
        gone = set()
        for early in lines[:d]:
            for shift in range(-len(early), len(late)):
                run = []
                for l in range(len(late) + 1):
                    e = l - shift
                    if l < len(late) and 0 <= e < len(early) and late[l] and late[l] == early[e]:
                        run.append(l)
                        continue
                    if sum(len(late[i]) for i in run) >= min_block:
                        gone.update(run)
                    run = []
        out.append(gone)
    return out


def patience_anywhere(texts, min_line, min_block):
    """Lines of each text in aligned blocks, by patience diff with every earlier text."""
    lines = [[x.strip(SPACE) for x in t.split("\n")] for t in texts]
    out = []
    for d, late in enumerate(lines):
        gone = set()
        for o, early in enumerate(lines[:d]):
            rows = [{"owner_id": o, "owner_v": 0, "length": len(x), "rare": len(x) >= min_line,
                     "early": [i for i, y in enumerate(early) if y == x],
                     "late": [i for i, y in enumerate(late) if y == x]}
                    for x in {*late} & {*early} if x]
            gone.update(line_dedup.deletions(rows, min_block)[0])
        out.append(gone)
    return out


def lines_left(text, gone):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def test_whole_blocks_of_any_earlier_document(spark):
    for seed in (1, 2, 3):
        some = [t for t in texts(seed) if all(x.strip(SPACE) for x in t.split("\n"))]
        rows = {r["doc_id"]: r for r in line_dedup.report(
            documents(spark, some), min_block=20, whole=True).collect()}
        held = held_anywhere(some, 20)
        assert [rows[d]["text"] for d in range(len(some))] == [
            lines_left(t, g) for t, g in zip(some, held)]
        assert all(a <= b for a, b in zip(patience_anywhere(some, 8, 20), held))


def test_a_block_whose_lines_others_held_before(spark):
    block = [f"line {i} of a passage that two documents hold" for i in range(5)]
    twice = "\n".join([*block, "between", *block])
    some = [f"{block[2]}\nsomething else", "\n".join(block), "\n".join(["own", *block, "end"])]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.report(
        documents(spark, some), whole=True).collect()}
    assert rows == {0: some[0], 1: some[1], 2: "own\nend"}
    some = [twice, "own\n" + "\n".join(block)]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.report(
        documents(spark, some), whole=True).collect()}
    assert rows == {0: twice, 1: "own"}


def test_a_passage_of_short_lines(spark):
    verse = "\n".join(f"verse {i} short" for i in range(12))
    rows = {r["doc_id"]: r["text"] for r in line_dedup.report(
        documents(spark, [verse, f"a\n{verse}\nb"]), whole=True).collect()}
    assert rows == {0: verse, 1: "a\nb"}


def test_blank_lines_do_not_part_a_block(spark):
    verse = "\n\n".join(f"verse {i}, in a paragraph of its own" for i in range(6))
    long = "\n \n".join(f"paragraph {i} " + "of many words " * 9 for i in range(3))
    some = [verse, verse.replace("\n\n", "\n"), f"a\n\n{verse}\n\nb", long, f"c\n{long}\n\nd"]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.report(
        documents(spark, some), whole=True).collect()}
    assert rows == {0: verse, 1: "", 2: "a\n\n\nb", 3: long, 4: "c\n\nd"}


def test_runs_around_blank_lines(spark):
    for seed in (4, 5):
        some = [t.replace("\n", "\n\n" if n % 3 else "\n") for n, t in enumerate(texts(seed))]
        rows = {r["doc_id"]: r["text"] for r in line_dedup.report(
            documents(spark, some), min_block=20, whole=True).collect()}
        dense = ["\n".join(x for x in t.split("\n") if x.strip(SPACE)) for t in some]
        left = [lines_left(t, g) for t, g in zip(dense, held_anywhere(dense, 20))]
        assert ["\n".join(x for x in rows[d].split("\n") if x.strip(SPACE))
                for d in range(len(some))] == left


def rounds_anywhere(texts, min_block):
    """Lines of each text in aligned blocks of rounds of patience diff with every earlier text:
    common runs of enough characters are ordered, the longest increasing chain goes, and the
    runs left are chained again until there is none."""
    lines = [[x.strip(SPACE) for x in t.split("\n") if x.strip(SPACE)] for t in texts]
    out = []
    for d, late in enumerate(lines):
        gone = set()
        for early in lines[:d]:
            left = set()
            for l in range(len(late)):
                for e in range(len(early)):
                    n = 0
                    while l + n < len(late) and e + n < len(early) and late[l + n] == early[e + n]:
                        n += 1
                    if sum(map(len, late[l:l + n])) >= min_block:
                        left.add((l, e, n))
            while left:
                best = {}
                for l, e, n in sorted(left):
                    before = [best[x] for x in best if x[0] < l and x[1] < e]
                    best[l, e, n] = max(before, key=len, default=[]) + [(l, e, n)]
                chain = max(best.values(), key=len)
                left.difference_update(chain)
                for l, _, n in chain:
                    gone.update(range(l, l + n))
        out.append(gone)
    return out


def test_equals_patience_diff_over_all_pairs(spark):
    for seed in (6, 7, 8):
        some = [t for t in texts(seed, 60) if all(x.strip(SPACE) for x in t.split("\n"))]
        # Blocks moved before one another, and a passage twice in a later text.
        parts = [[f"part {p} line {i} of seed {seed}" for i in range(3)] for p in range(4)]
        some += ["\n".join(sum((parts[p] for p in order), [f"own {order}"]))
                 for order in ([0, 1, 2, 3], [3, 1, 0, 2], [2, 2, 1], [1, 0, 1, 0])]
        rows = {r["doc_id"]: r for r in line_dedup.report(
            documents(spark, some), min_block=20, whole=True).collect()}
        gone = rounds_anywhere(some, 20)
        assert [rows[d]["text"] for d in range(len(some))] == [
            lines_left(t, g) for t, g in zip(some, gone)]
        assert [rows[d]["gone_lines"] for d in range(len(some))] == [len(g) for g in gone]
        assert all(bool(rows[d]["owners"]) == bool(g) for d, g in enumerate(gone))


def test_first_chain_is_patience_diff():
    """The longest run in order comes first, whatever is left is dealt to few further chains."""
    anchors = [(3, 0, 1, True), (4, 1, 1, True), (5, 2, 1, True), (0, 3, 2, True), (1, 4, 1, True),
               (9, 0, 1, False)]
    found = line_dedup.chains(anchors)
    assert found == [[(3, 0, 1), (4, 1, 1), (5, 2, 1)], [(0, 3, 2), (1, 4, 1)], [(9, 0, 1)]]
    assert [line_dedup.blocks_of(c) for c in found] == [[(3, 0, 3)], [(0, 3, 2)], [(9, 0, 1)]]
    r = random.Random(3)
    for _ in range(200):
        some = [(r.randrange(12), r.randrange(12), r.randint(1, 3), r.random() < 0.5)
                for _ in range(r.randint(0, 15))]
        dealt = line_dedup.chains(some)
        assert sorted((l, e) for c in dealt for l, e, _ in c) == sorted({x[:2] for x in some})
        assert all(a[0] < b[0] and a[1] < b[1] for c in dealt for a, b in zip(c, c[1:]))


def test_odd_rows_of_whole_blocks(spark):
    docs = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    clean = line_dedup.dedup_lines(docs, whole=True)
    assert clean.schema == docs.schema
    assert sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.report(empty, whole=True).count() == 0
    passage = "\n".join(f"line {i} of a passage that is held by two" for i in range(5))
    # Equal rows are one document; rows that share only the id are told apart; a row without
    # an id or text stays and holds nothing against others.
    some = [passage, passage, "x\n" + passage, passage, "other\n" + passage, None, ""]
    rows = line_dedup.report(
        documents(spark, some, [5, 5, 5, 6, None, 7, 8]), whole=True).collect()
    left = sorted((r["doc_id"] or 0, str(r["text"]), r["gone_lines"]) for r in rows)
    fives = [x for x in left if x[0] == 5]
    assert [x for x in left if x[0] != 5] == [
        (0, "other\n" + passage, 0), (6, "", 5), (7, "None", 0), (8, "", 0)]
    # The smaller text hash of id 5 is the earlier.
    assert fives in ([(5, "", 5), (5, "", 5), (5, "x\n" + passage, 0)],
                     [(5, passage, 0), (5, passage, 0), (5, "x", 5)])


def test_very_many_lines(spark):
    long = "\n".join(f"line {i} of a document of very many lines" for i in range(80_000))
    turned = "\n".join(reversed([f"{x} {x} {x}" for x in long.split("\n")[:20_000]]))
    straight = "\n".join(reversed(turned.split("\n")))
    some = [long, f"head\n{long}\ntail", straight, f"{turned}\nend"]
    rows = {r["doc_id"]: r for r in line_dedup.report(
        documents(spark, some), whole=True).collect()}
    assert [rows[d]["gone_lines"] for d in range(4)] == [0, 80_000, 0, 20_000]
    assert rows[1]["text"] == "head\ntail" and rows[3]["text"] == "end"
    assert rows[1]["owners"] == [0] and rows[3]["owners"] == [2]
