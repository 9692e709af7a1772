"""A chat API over HTTP on this machine: what a test says that there is, by path, and messages by channel."""

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse


@contextmanager
def serving(answers: dict, messages: dict[int, list[dict]], broken: dict[str, list[int]] | None = None):
    """``answers``: JSON or a status by path; ``broken``: statuses that a path gives before it answers. Gives the url and the paths asked."""
    asked, broken = [], broken or {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            params = {k: v[0] for k, v in parse_qs(url.query).items()}
            asked.append((url.path, params))
            out = answers.get(url.path)
            if broken.get(url.path):
                out = broken[url.path].pop(0)
            elif callable(out):
                out = out(params)
            elif url.path.endswith("/messages") and not isinstance(out, int):
                rows = sorted(messages.get(int(url.path.split("/")[2]), []), key=lambda m: int(m["id"]))
                if "after" in params:
                    out = [m for m in rows if int(m["id"]) > int(params["after"])][: int(params["limit"])][::-1]
                else:
                    out = [m for m in rows if "before" not in params or int(m["id"]) < int(params["before"])][::-1][: int(params["limit"])]
            status = out if isinstance(out, int) else 404 if out is None else 200
            body = json.dumps(out).encode() if status == 200 else b"{}"
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "0")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", asked
    finally:
        server.shutdown()
