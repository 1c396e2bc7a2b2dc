"""Listings in a page's own state: fields, nesting, copies, links, histories, totals."""

import json

from fathomline.sources import listings, records

VIN, OTHER = "1ABCD23E4F5G67891", "2ABCD23E4F5G67892"


def pages_of(spark, *bodies):
    return spark.createDataFrame([(i, "https://cars.example.com/list", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def state(value):
    return f"<script>window.__S = {json.dumps(value)};</script>"


def rows(spark, *bodies, generic=True):
    return [(r.page_id, r.row) for r in listings.listing_rows(pages_of(spark, *bodies), generic=generic).orderBy("page_id", "place").collect()]


def test_a_vehicle_in_script_state(spark):
    car = {
        "year": 2020, "make": {"name": "Mazda", "code": "MZ"}, "model": "CX-5", "trim": "Touring", "vin": VIN, "mileage": 19612, "transmission": "Automatic", "engine": "2.5L I4", "exteriorColor": "Red",
        "details": {"dealerDistanceMiles": 97, "searchRadius": 500}, "pricing": {"current": 21995, "monthlyPayment": 300}, "dealer": {"name": "North Motors", "city": "Salem", "state": "OR", "zip": "97301"}, "detailUrl": "../car/1",
    }
    car["detailUrl"] = "/car/1"
    want = f"2020 Mazda CX-5 Touring | $21,995 | 19,612 mi | Automatic | 2.5L I4 | Red | VIN {VIN} | North Motors (Salem, OR, 97301) | distance 97 | https://cars.example.com/car/1"
    assert rows(spark, state({"results": [car]})) == [(0, want)]


def test_names_prices_and_what_is_no_listing(spark):
    shoe = {"productName": "Trail shoe", "brand": "Runner", "salePrice": "$89.50", "originalPrice": 120, "sku": "S-1", "condition": "https://schema.org/NewCondition"}
    attribute = "<div data-item='" + json.dumps(shoe) + "'></div>"
    noise = state([{"name": "Express shipping", "price": 9.99}, {"title": "Free thing", "price": 0, "id": "a1"}, {"imvPrice": 5, "name": "estimate", "id": "b2"}, {"name": "flag", "price": True, "id": 7}])
    assert rows(spark, attribute + noise, None, "", "<script>{\"name\": broken</script>") == [(0, "New Runner Trail shoe | $90")]


def test_the_innermost_named_object_is_the_item(spark):
    inner = {"title": "Oak table", "price": 140, "id": "t-100"}
    wrapper = {"name": "Widget of many", "price": 1, "id": "w-1", "child": {"deep": [inner]}}
    part = {"make": "Oak", "model": "T2", "price": 140, "id": "x", "child": inner}
    assert rows(spark, state(wrapper)) == [(0, "Oak table | $140")] and rows(spark, state(part)) == [(0, "Oak table | $140")]


def test_copies_fill_each_other_and_twins_are_one(spark):
    node = {"@type": "Car", "name": "2020 Mazda", "vehicleIdentificationNumber": VIN, "offers": {"price": 21995}}
    ld = f'<script type="application/ld+json">{json.dumps(node)}</script>'
    twin = {"vin": VIN, "name": "2020 Mazda CX-5", "distance": 12.4, "transmission": "Manual", "price": 1}
    got = rows(spark, ld + state(twin), ld, state([{"name": "Lamp", "price": 5, "id": "1"}, {"name": "Lamp, brass", "price": 5, "id": "2"}]))
    assert got == [(0, f"2020 Mazda | $21,995 | Manual | VIN {VIN} | distance 12"), (1, f"2020 Mazda | $21,995 | VIN {VIN}"), (2, "Lamp, brass | $5")]


def test_links_by_identifier(spark):
    items = [{"name": "Lamp", "price": 5, "listingId": 458801235}, {"name": "Rug", "price": 6, "listingId": 458801236}, {"name": "Jar", "price": 7, "listingId": 458801237}, {"name": "Cup", "price": 8, "listingId": 458801237}]
    hrefs = '<a href="/details/458801235?x=1">a</a><a href="https://cars.example.com/d-458801236-a">b</a><a href="/e/458801236">c</a><a href="/f/458801237">d</a><a href="https://other.example.org/458801235">e</a>'
    got = dict((r.rsplit(" | ")[0], r) for _, r in rows(spark, state(items) + hrefs))
    assert got == {"Lamp": "Lamp | $5 | https://cars.example.com/details/458801235?x=1", "Rug": "Rug | $6", "Jar": "Jar | $7", "Cup": "Cup | $8"}


def test_histories_belong_to_the_one_vehicle_around_them(spark):
    facts = {"accidentCount": 1, "ownerCount": 2, "isCleanTitle": True, "oneOwner": False, "salvage": False, "lemon": False, "hasFrameDamage": True, "ownerName": "x", "summary": ["NO_FLOOD_DAMAGE", "OTHER_CODE"]}
    one = {"vehicle": {"vin": {"value": VIN, "invalidVin": False}}, "report": {"history": facts}}
    both = {"cars": [{"vin": OTHER, "name": "b", "price": 2}, {"vin": VIN, "name": "a", "price": 1}], "accidentCount": 3}
    got = records.histories(records.page_objects(pages_of(spark, state(one), state(both)))).collect()
    assert [(r.page_id, r.key, r.history) for r in got] == [(0, VIN, "1 accident, 2 owners, clean title, one owner: no, frame damage, no flood damage, no salvage title/lemon record")]


def test_sections_and_totals(spark):
    from pyspark.sql import functions as F

    counts = '{"totalCount": 1204, "resultCount":1204, "facetCount": 9, "total_results": "3"}'
    pages = pages_of(spark, state({"name": "Lamp", "price": 5, "id": "1"}) + f"<script>var x={counts}</script>", '<script>var a={"totalCount":0,"resultsCount":0}</script>', '<script>var a={"totalCount":7}</script>', None)
    got = {r.page_id: r.text for r in listings.with_listings(pages, F.lit("prose")).collect()}
    assert got == {
        0: "prose\n\n## Listings\n\nThe page's own data reports 1,204 results in all.\n\n- Lamp | $5", 1: "prose\n\n## Listings\n\nNo matches: the page's own data reports 0 results.", 2: "prose", 3: "prose",
    }


def test_relay_listings_are_read_whole(spark):
    listing = lambda i, **more: json.dumps({"listing": {"id": str(i), "marketplace_listing_title": "a {brace} \"quoted\"", "listing_price": {"amount": "5.00"}, **more}})
    body = "[" + ",".join([listing(1), listing(2, is_sold=True, location={"reverse": {"city": "X"}}), listing(1), '{"listing":null}', '{"listing":{"id":"3",broken']) + "]"
    got = listings.relay_listings(pages_of(spark, body, '{"marketplace_search":{"feed_units":null}}')).orderBy("identity").collect()
    assert [(r.identity, r.amount, r.currency, r.sold) for r in got] == [("fbmp:1", 5.0, "USD", False), ("fbmp:2", 5.0, "USD", True)]
