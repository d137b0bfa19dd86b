"""A small HTTP server over the annotation plan: ``POST /api/infer`` with ``{"text": ...}``, and ``GET /health``.

Requests are answered side by side, each a thread, over one prepared index.  For trying texts by hand; many notes are annotated as
one batch or stream, not by requests.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from medspan.plans.annotate import Options, Prepared, infer_json
from medspan.sources.index import Index


def answer(index: Prepared, body: bytes) -> tuple[int, dict]:
    """Status and result for the body of a request."""
    try:
        payload = json.loads(body.decode("utf-8"))
    except ValueError:
        payload = None
    if not isinstance(payload, dict):
        return 400, {"error": "expected a JSON object with a text field"}
    text = payload.get("text")
    if not isinstance(text, str) or not text.strip():
        return 400, {"error": "field text must be a non-empty string"}
    try:
        return 200, json.loads(infer_json(index, text))
    except Exception as error:  # whatever the engine raises is the answer's, not the server's end
        return 500, {"error": f"{type(error).__name__}: {error}"[:2000]}


def server(index: Index, index_dir: str, options: Options | None = None, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but not yet running (``serve_forever``)."""
    ready = Prepared(index, options)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value: dict) -> None:
            body = json.dumps(value).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._send(*((200, {"ok": True, "index_dir": index_dir}) if self.path.split("?")[0] == "/health" else (404, {"error": "not found"})))

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", "0")))
            self._send(*(answer(ready, body) if self.path.split("?")[0] == "/api/infer" else (404, {"error": "not found"})))

    return ThreadingHTTPServer((host, port), Handler)
