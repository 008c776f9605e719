import random

from linkloom.llm.quotes import Settings, in_reply_order, link_quotations, normal, op8_quotation_linking, parse

SF = "/root/testdata/sf0.01"


def brute(rows, line_words=3):
    """(conv, turn, own text, parent, by quote) of (conv, turn, role, text) rows, by scanning."""
    out = []
    parts = [(c, t, *parse(x or "")) for c, t, _, x in rows]
    for conv, turn, own, passages in parts:
        earlier = [p for p in parts if p[0] == conv and turn is not None and p[1] is not None and p[1] < turn]
        best = None

        def holds(p, text):
            lines = [normal(x) for x in p[2].split("\n")]
            paragraphs, block = [], []
            for line in [*p[2].split("\n"), ""]:
                if line.strip(" \t"):
                    block.append(line)
                elif block:
                    paragraphs.append(normal(" ".join(block)))
                    block = []
            return bool(text) and (text == normal(p[2]) or text in paragraphs or (text in lines and len(text.split()) >= line_words))

        for level, lines in passages:
            for rank, texts in ((0, [normal(" ".join(lines))]), (1, [n for n in map(normal, lines) if len(n.split()) >= line_words])):
                for text in texts:
                    for p in earlier:
                        if holds(p, text):
                            key = (level, rank, -p[1])
                            best = min(best, key) if best else key
        parent = -best[2] if best else max((p[1] for p in earlier), default=None)
        out.append((conv, turn, own, parent, best is not None))
    return sorted(out, key=str)


def trees(found):
    """(conv, turn) -> (thread, depth, branch) by climbing from every turn."""
    up = {}
    for conv, turn, _, parent, _ in found:
        if turn is not None:
            up.setdefault((conv, turn), []).append(parent)
    out = {}
    for conv, turn in up:
        t, depth, branch = turn, 0, None
        while True:
            parents = [p for p in up[conv, t] if p is not None]
            before = max((x for c, x in up if c == conv and x < t), default=None)
            parent = min(parents, default=None)
            if branch is None and (parent is None or parent != before):
                branch = t
            if parent is None:
                break
            t, depth = parent, depth + 1
        out[conv, turn] = (t, depth, branch)
    return out


def check_trees(df):
    rows = df.collect()
    want = trees([(r.conv_id, r.turn, r.text, r.parent_turn, r.by_quote) for r in rows])
    for r in rows:
        assert (r.thread, r.depth, r.branch) == (want[r.conv_id, r.turn] if r.turn is not None else (None, None, None))


def rows_of(df):
    return sorted(((r.conv_id, r.turn, r.text, r.parent_turn, r.by_quote) for r in df.collect()), key=str)


def test_parse():
    assert parse("hi\n> a b\n>> c\n>> d\n> e\nbye") == ("hi\nbye", [(1, ["a b"]), (2, ["c", "d"]), (1, ["e"])])
    assert parse("On Monday, Ann wrote:\n> x") == ("", [(1, ["x"])])
    assert parse("") == ("", [])


def test_links_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(6):
        texts = []
        for turn in range(rng.randrange(3, 30)):
            own = "\n".join(" ".join(rng.choices("alpha beta gamma delta eps".split(), k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4)))
            quote = ""
            if texts and rng.random() < 0.7:
                source = rng.choice(texts).split("\n")
                if rng.random() < 0.4:
                    source = source[:1]
                quote = "\n".join(">" * rng.randrange(1, 3) + " " + s.upper() for s in source) + "\n"
            texts.append(own)
            rows.append((conv, turn * rng.choice([1, 1, 300]) if turn else 0, "user", quote + own))
    rows += [(9, 0, None, None), (9, 1, "user", ""), (9, None, "user", "> lost"), (None, 0, "user", "null conversation here"), (None, 1, "user", "> null conversation here\nyes"), (None, 1, "user", "> null conversation here\nyes"), (10, 5, "user", "long words " * 40_000), (10, 6, "user", "> " + "long words " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as message", "2 as hash", "3 as parent_turn")
    assert rows_of(link_quotations(df)) == brute(rows)
    assert rows_of(link_quotations(df, Settings(stretch=3))) == brute(rows)
    check_trees(link_quotations(df))
    seen = set()
    for r in in_reply_order(link_quotations(df)).collect():  # parents come before replies
        assert r.parent_turn is None or (r.conv_id, r.parent_turn) in seen
        seen.add((r.conv_id, r.turn))
    assert link_quotations(df.limit(0)).count() == 0


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op8_quotation_linking(spark, SF)
    assert rows_of(found) == brute(rows)
    check_trees(found)
    keys = [(r.conv_id, r.thread, r.branch, r.turn) for r in found.collect()]
    assert keys == sorted(keys)
