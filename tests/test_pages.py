"""One-pass readers: against the node array, on long and odd pages."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.session import BATCH_BYTES, prepare
from lotwise.sources import pages as P
from lotwise.sources.reading import HIDDEN_IN_DETAILS, PRIVATE_AREA, CardReader, CardShape, DetailReader, DetailShape

PAGES = "page_id bigint, html string"
SHAPE = CardShape(card_name="item-card", fields=frozenset({"title", "fact"}))


def cards(html):
    return CardReader(SHAPE).read(html).found


def test_cards_in_cards_and_hidden_parts():
    html = (
        '<div data-testid="item-card"><p data-field="title">outer <b>one</b><script>var x = 1;</script>'
        '<div data-testid="item-card"><a href="/item/2"><i data-field="title">inner</i></a></div><noscript><a href="/no">no</a></noscript></div>'
        '<script><div data-testid="item-card"></div></script><div data-testid="item-card"'
    )
    outer, inner = cards(html)
    assert outer["texts"] == ["outer ", "one", "inner"] and inner["texts"] == ["inner"]
    assert [x["href"] for x in outer["links"]] == ["/item/2"] == [x["href"] for x in inner["links"]]
    # The inner card ends the paragraph it stands in.
    assert [(k, parts) for k, parts in outer["kept"]] == [("field:title", ["outer ", "one"]), ("field:title", ["inner"])]


def test_only_the_first_heading_counts():
    shape = CardShape(card_tag="article", heading=frozenset({"h1", "h2"}))
    html = '<article><a href="/a"></a><h2><a href="/b"></a></h2><h2><a href="/c"></a></h2></article>'
    (card,) = CardReader(shape).read(html).found
    assert [(x["href"], x["heading"]) for x in card["links"]] == [("/a", False), ("/b", True), ("/c", False)]


def naive_pairs(html):
    """Pairs by the node array: for each paragraph, its grandparent and all paragraphs inside that."""
    nodes = P._NodeReader("data-testid", "data-field").read(html).nodes
    hides = [n for n in nodes if n["tag"] in HIDDEN_IN_DETAILS or PRIVATE_AREA.search(n.get("name") or "")]
    shown = [n for n in nodes if not any(h["seq"] <= n["seq"] <= h["last"] for h in hides)]
    area = next((n for n in shown if n.get("name") == DetailShape.details), None)
    if area is None:
        return []
    by = {n["seq"]: n for n in shown}
    text = lambda p: " ".join(n["text"] for n in shown if n["tag"] == "#text" and p["seq"] <= n["seq"] <= p["last"])
    out = []
    for p in shown:
        if p["tag"] != "p" or not area["seq"] <= p["seq"] <= area["last"]:
            continue
        above = by.get(by[p["parent"]]["parent"]) if p["parent"] in by else None
        inside = [n for n in shown if above and n["tag"] == "p" and above["seq"] <= n["seq"] <= above["last"]]
        if len(inside) == 2 and inside[0] is p:
            out.append((text(p), text(inside[1])))
    return out


def test_pairs_like_a_search_over_all_nodes():
    rng = random.Random(3)

    def tree(depth):
        if depth == 0 or rng.random() < 0.25:
            return f"<p>{rng.choice('abcdef')}<b>{rng.choice('uvw')}</b></p>" if rng.random() < 0.8 else rng.choice(["x", "<button>y</button>", "<form><p>z</p></form>"])
        tag = rng.choice(["div", "div", "section", "span", "ul"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(rng.randint(1, 3)))}</{tag}>"

    found = 0
    for _ in range(300):
        html = f'<body>{tree(3)}<div data-testid="{DetailShape.details}">{tree(4)}{tree(4)}</div>{tree(2)}</body>'
        got = [(a, b) for _, a, b in sorted(DetailReader(DetailShape()).read(html).pairs, key=lambda p: p[0])]
        assert got == naive_pairs(html), html
        found += len(got)
    assert found > 100


def test_twenty_thousand_nodes_take_four_times_five_thousand():
    def seconds(n):
        card = '<div data-testid="item-card"><a href="/item/1"><b>x</b></a><p data-field="title">t</p></div>'
        pair = "<div><div><p>Marca</p></div><div><p>v</p></div></div>"
        deep = "<div>" * (n // 8) + "</div>" * (n // 8)
        start = time.process_time()
        assert len(cards(card * (n // 8) + deep + "</i>" * n)) == n // 8
        read = DetailReader(DetailShape()).read(f'<div data-testid="{DetailShape.details}">{pair * (n // 10)}{deep}</div>')
        assert len(read.pairs) == n // 10
        return time.process_time() - start

    seconds(2_000)
    assert seconds(20_000) < 12 * max(seconds(5_000), 0.01)


def test_odd_pages_give_defined_rows(spark):
    long = "<p>" + "word " * 50_000 + "</p>"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<<>"), (4, long), (None, '<div data-testid="item-card"><b>t</b></div>')], PAGES)
    rows = P.extract_cards(df).collect()
    assert [(r["page_id"], r["title"], r["reasons"]) for r in rows] == [(None, "t", ["a canonical item URL is required"])]
    assert {r["page_id"]: (r["conflict"], r["details"]) for r in P.extract_labelled_pairs(df).collect()} == {k: (False, {}) for k in (1, 2, 3, 4, None)}
    assert P.extract_articles(df.limit(0)).count() == 0


def test_facts_of_one_page(spark):
    def pair(label, value):
        return f"<div><div><p>{label}</p></div><div><p>{value}</p></div></div>"

    html = (
        '<link rel="canonical" href="https://www.market.example/a?x=1"><div data-testid="content-description-section"><p>3 de maio de 2024</p></div>'
        f'<div data-testid="{DetailShape.details}">' + pair("Marca", "vw") + pair("Modelo", "Golf") + pair("Quilómetros", "85 000 km") + pair("Potência", "110 kW")
        + pair("Ano", "2019") + pair("Origem", "importada") + "</div>"
    )
    df = spark.createDataFrame([(1, html, "https://www.market.example/a")], PAGES + ", url string")
    row = P.detail_facts(df, F.lit(2024), url="url").first()
    assert (row["make"], row["model"], row["mileage"], row["power_hp"], row["year"], row["imported"]) == ("Volkswagen", "Golf", 85_000, 148, 2019, True)
    assert (row["posted"], row["same_page"], row["seller_type"], row["fuel"]) == ("3 de maio de 2024", True, None, None)


def test_embedded_data_of_any_depth():
    from lotwise.sources.embedded import embedded_values

    deep = "{" + '"a":{' * 50 + '"horse_power":{"value":150}' + "}" * 50 + "}"
    html = (
        '<script>call("x",{"feed":{"horse_power":999,"specs":{"horsepower":888}},"vehicle_specifications":' + deep
        + ',"vehicle_make":null,"vehicleMake":{"z":{"q":1},"name":"B\\u004dW"},"vehicle_odometer_data":{"raw":{"value":"x}"},"unit":"MILES","value":1000.5},'
        + "'transmission':'it\\'s manual',\"trim\":7});</script><p>{\"vehicle_year\":1999}</p>"
    )
    got = embedded_values(html)
    assert (got["power"], got["odometer_unit"], got["gearbox"], got["trim"], got["year"]) == ("150", "MILES", "it\\'s manual", "7", None)
    assert got["make"] == "B\\u004dW" and got["odometer_value"] == "x}"
    assert embedded_values(None) == embedded_values("<script>{{{</script>") == dict.fromkeys(got)
    # An object that never ends has no span; the next one counts.
    cut = '<script>{"vehicle_specifications":{"horse_power":1,</script><script>"specifications":{"power_hp":90}</script>'
    assert embedded_values(cut)["power"] == "90"


def test_embedded_objects_are_measured_once():
    from lotwise.sources.embedded import embedded_values

    def seconds(n):
        start = time.process_time()
        embedded_values("<script>" + '{"vehicle_make":{"x":' * n + "</script>")
        return time.process_time() - start

    seconds(100)
    assert seconds(400) < 60 * max(seconds(100), 0.002)


def test_descriptions_lose_location_notes(spark):
    html = '<div data-field="description"><p>A car with many extras, well kept.</p><p>Location is approximate</p><p>Call in the evening.</p></div>'
    df = P.page_nodes(spark.createDataFrame([(1, html)], PAGES))
    assert df.select(P.extract_detail_description(F.col("nodes"))).first()[0] == "A car with many extras, well kept. Call in the evening."


def test_readers_work_off_a_large_batch_in_portions(spark, monkeypatch):
    from lotwise.sources import embedded, reading

    page = '<html><body><div data-testid="item-card"><p data-field="title">car</p></div>' + "<i>word</i>" * 4000 + "</body></html>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": [page] * 100})
    source = spark.createDataFrame([], PAGES)
    taken = []
    monkeypatch.setattr(type(source), "mapInArrow", lambda self, read, schema: taken.append(read))
    P.page_nodes(source)
    reading.read_cards(source, SHAPE)
    reading.read_details(source)
    embedded.read_embedded(source)
    for read in taken:
        parts = list(read(iter([batch])))
        assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(100))
        assert max(p.num_rows for p in parts) < 30
    assert len(taken) == 4


def test_batches_for_python_are_bounded_in_bytes(spark):
    prepare(spark)
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("page_id"), F.repeat(F.lit("x"), 10_000).alias("html"))

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    sizes = [r["n"] for r in rows.mapInArrow(counted, "n bigint").collect()]
    assert sum(sizes) == 3000 and max(sizes) * 10_000 < 2 * BATCH_BYTES


def test_addresses_of_details_are_not_broadcast(spark):
    pages = spark.range(1, 2).select(F.col("id").alias("page_id"), F.lit("https://x.example/1").alias("url"), F.lit("<p>a</p>").alias("html"))
    out = P.detail_facts(pages, F.lit(2024), url="url")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["page_id"] for r in out.collect()] == [1]
