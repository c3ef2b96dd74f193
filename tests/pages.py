"""Pages for the crawl's tests, importable where the source runs."""

import json


def fetch(url):
    pages = {"a": ([{"id": "x", "downloads": 1}, {"id": "y"}], "b"), "b": ([{"id": "z", "downloads": 3}], None)}
    rows, after = pages[url]
    return 200, {"Link": f'<{after}>; rel="next"'} if after else {}, json.dumps(rows)
