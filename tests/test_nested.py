import json

from pyspark.sql import functions as F

from conftest import SMALL
from emberline.operators.nested import ROOT, Reader, child_items, flat_table, plan_tables, schema_graph, shred
from emberline.plans.nested import p3_found
from emberline.sources.game_text import AGENT_LOG, GAME_LOG, RESPONSE, agent_record, fenced_object, game_events, player_labels

JSON = Reader(lambda t: json.loads(t) if t.startswith("{") else None)


def rows(spark, texts, reader=JSON):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id bigint, t string")
    return shred(df, "id", "t", reader)


def test_plan_kinds():
    edges = [("$", "a", "object"), ("a", "x", "scalar"), ("$", "l", "list"), ("l", "l[]", "item object"), ("l[]", "s", "object"), ("$", "s", "object"), ("$", "n", "object"), ("n", "n", "object")]
    plan = plan_tables(edges)
    assert plan.tables == {"$": "root", "l[]": "repeated", "s": "shared", "n": "shared"} or plan.tables["n"] in ("recursive", "shared")
    assert "a" not in plan.tables


def test_recursive_element_gets_a_table(spark):
    out = rows(spark, ['{"node": {"v": 1, "node": {"v": 2, "node": {"v": 3}}}}'])
    got = sorted((tuple(r.path), r.columns.get("v"), r.parent_table) for r in out.collect() if r.table == "node")
    assert got == [((1,), "1", ROOT), ((1, 1), "2", "node"), ((1, 1, 1), "3", "node")]


def test_shared_inlining_round_trip(spark):
    text = json.dumps({"a": {"b": {"c": 5}}, "list": [{"k": "x"}, None, {"k": None}, 7], "m": {"1": "p", "2": None, "10": "q"}})
    out = rows(spark, [text, "broken", '{"a": null, "list": []}', "{}"]).collect()
    root = {r.rec_id: r.columns for r in out if r.table == ROOT}
    assert root == {1: {"a.b.c": "5"}, 3: {}, 4: {}}
    assert [(r.place, r.columns.get("k"), r.item_text) for r in out if r.table == "list[]"] == [(1, "x", None), (3, None, None), (4, None, "7")]
    assert [(r.place, r.item_text) for r in out if r.table == "m.#"] == [(1, "p"), (10, "q")]


def test_children_carry_their_parents_key(spark):
    out = rows(spark, ['{"e": [{"l": [1, 2]}, {"l": [3]}]}'])
    got = sorted((r.parent_no, r.item_no, r.item_text) for r in child_items(out).filter("table = 'l[]'").collect())
    assert got == [(1, 1, "1"), (1, 2, "2"), (2, 1, "3")]
    events = flat_table(out, "e[]", {"l": "l"}).collect()
    assert sorted(tuple(r.path) for r in events) == [(1,), (2,)]


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "id bigint, t string")
    assert shred(empty, "id", "t", JSON).count() == 0
    out = rows(spark, ['{"table": 1, "path": {"rec_id": 2}, "columns": "x"}']).collect()
    assert [r.columns for r in out] == [{"table": "1", "path.rec_id": "2", "columns": "x"}]


def test_graph_counts(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": {"b": 2}}')], "id bigint, t string")
    got = {(r.parent, r.member, r.kind): r.n for r in schema_graph(df, "t", JSON).collect()}
    assert got == {("$", "a", "scalar"): 1, ("$", "a", "object"): 1, ("a", "b", "scalar"): 1}


def test_layouts_of_game_files():
    event = {"event": "vote", "content": {"vote_target": 3}}
    want = {"events": [event, event]}
    assert game_events(json.dumps([event, event])) == want
    assert game_events(json.dumps({"game": "x", "game_log": [event, event]})) == want
    assert game_events(json.dumps(event) + "\n\n" + json.dumps(event) + "\n") == want
    assert game_events(json.dumps([{**event, "content": json.dumps(event["content"])}])) == {"events": [event]}
    assert game_events('[{"event": "vo') is None
    assert game_events(json.dumps(event) + '\n{"event"') is None


def test_labels_from_text():
    assert fenced_object('x\n```json\n{"a": 1}\n``` ```{}```') == {"a": 1}
    assert fenced_object("```json\n{") is None and fenced_object("[1]") is None and fenced_object(None) is None
    assert player_labels({"Identity Labels": {"Player 2": "Seer", "Player x": "a", "Player 3": 4}, "Player 1": "Guard"}) == {"Player 2": "Seer"}
    assert player_labels({"Identity Labels": None, "Player 1": "Guard"}) == {"Player 1": "Guard"}
    assert agent_record('{"interaction": {"prompt": "{\\"Phase\\": \\"x\\"}"}}')["interaction"]["prompt"] == {"Phase": "x"}


def test_readers_skip_what_does_not_parse(spark):
    for reader in (GAME_LOG, AGENT_LOG, RESPONSE):
        assert rows(spark, ["", "nonsense", "[1"], reader).count() == 0


def test_found_against_brute_force(spark):
    """Items counted straight from the parsed texts of the smallest tables."""
    want = set()
    for r in spark.read.parquet(f"{SMALL}/agent_log.parquet").collect():
        record = agent_record(r.record) or {}
        prompt = record.get("interaction", {}).get("prompt")
        if isinstance(prompt, dict):
            want |= {("agent_log", r.line_id, 0, "roster", i, x) for i, x in enumerate(prompt.get("Player Roster") or [], 1) if x is not None}
            tries = enumerate(prompt.get("Action Repair Attempts") or [], 1)
            want |= {("agent_log", r.line_id, 0, "repair", i, x["invalid_action"]) for i, x in tries if x.get("invalid_action") is not None}
    for r in spark.read.parquet(f"{SMALL}/player_trace.parquet").collect():
        labels = player_labels(fenced_object(r.response) or {})
        want |= {("player_trace", r.trace_id, 0, "identity_labels", int(k[7:]), v) for k, v in labels.items()}
    for r in spark.read.parquet(f"{SMALL}/game_log.parquet").collect():
        for n, e in enumerate((game_events(r.payload) or {"events": []})["events"], 1):
            content = e.get("content") or {}
            for name in ("wolf_team", "dead_list", "speech_queue", "vote_queue"):
                want |= {("game_log", r.file_id, n, name, i, str(x)) for i, x in enumerate(content.get(name) or [], 1) if x is not None}
            want |= {("game_log", r.file_id, n, "identity_labels", int(k[7:]), v) for k, v in (content.get("identity_labels") or {}).items()}
            if e["event"] == "god_view":
                want |= {("game_log", r.file_id, n, "role_map", int(k), v) for k, v in content.items() if v is not None}
    got = p3_found(spark, SMALL)
    assert got.columns == ["tab", "rec_id", "parent_no", "list_name", "item_no", "item_text"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_keys_of_like_named_lists_and_objects(spark):
    out = rows(spark, ['{"p": {"items": [1, 2], "addr": {"x": 1}}, "q": {"items": [1, 3], "addr": {"x": 1}}}']).collect()
    keys = [(r.table, r.row_key) for r in out]
    assert len(set(keys)) == len(keys)
    root = next(r for r in out if r.table == ROOT)
    assert all(r.parent_key == root.row_key for r in out if r.table != ROOT)
    assert sorted(r.item_text for r in out if r.table == "items[]") == ["1", "1", "2", "3"]
    assert len([r for r in out if r.table == "addr"]) == 2


def test_member_names_stay_apart(spark):
    out = rows(spark, ['{"a.b": 1, "a": {"b": 2}, "m": {"Player 7": "x", "Slot 7": "y", "7": "z"}}']).collect()
    assert next(r.columns for r in out if r.table == ROOT) == {"a\\.b": "1", "a.b": "2"}
    members = [r for r in out if r.table == "m.#"]
    assert {(r.name, r.place, r.item_text) for r in members} == {("Player 7", 7, "x"), ("Slot 7", 7, "y"), ("7", 7, "z")}
    assert len({r.row_key for r in members}) == 3


def test_any_depth(spark):
    from emberline.sources.game_text import loads

    reader = Reader(loads)
    n = 100_000
    texts = ['{"c": ' * n + '{"v": 1}' + "}" * n, "[" * n + "5" + "]" * n, '{"1": ' * n + '"x"' + "}" * n]
    out = rows(spark, texts, reader).persist()
    counts = {(r.rec_id, r.table): r["count"] for r in out.groupBy("rec_id", "table").count().collect()}
    assert counts == {(1, ROOT): 1, (1, "c"): n, (2, ROOT): 1, (2, "$[]"): n, (3, ROOT): 1, (3, "$.#"): n}
    assert out.select("rec_id", "row_key").distinct().count() == out.count()
    parents = out.select("rec_id", F.col("row_key").alias("parent_key"))
    assert out.filter("parent_key IS NOT NULL").join(parents, ["rec_id", "parent_key"]).count() == 3 * n
    assert out.filter("item_text IS NOT NULL OR size(columns) > 0").count() == 3
    out.unpersist()


def test_deep_parser_agrees():
    from emberline.sources.game_text import loads_deep

    for text in ('{"a": [1, {"b": null}, []], "c": {}, "d": "x\\n", "e": -1.5e3, "f": [true, false]}', " [ ] ", "7", '"s"', "[[1],[2,[3]]]", '{"a":{"b":{"c":[{}]}},"d":1}'):
        assert loads_deep(text) == json.loads(text)
    for text in ("", "[1", "[1,]", '{"a"}', '{"a":1,}', "{1:2}", "[1]]", '{"a":1 "b":2}', "nonsense", "[,]"):
        assert loads_deep(text) is None


def test_names_that_are_data_become_maps(spark):
    from emberline.operators.nested import learn_plan

    texts = [json.dumps({"by": {f"user{i}x{j}": {"v": j} for j in range(50)}, "rest": {"k": [1]}}) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    plan = learn_plan(df, "t", JSON, most=200)
    assert plan.maps == {"by"}
    out = shred(df, "id", "t", JSON, plan).collect()
    assert len([r for r in out if r.table == "by.#"]) == 1000 and len({(r.rec_id, r.row_key) for r in out}) == len(out)
    assert {r.name for r in out if r.table == "by.#"} == {f"user{i}x{j}" for i in range(20) for j in range(50)}
