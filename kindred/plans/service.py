"""The engine's answers over HTTP, by the standard library: requests are met one at a time, as each may move prototypes."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from pyspark.sql import functions as F

from kindred.plans.jobs import Engine
from kindred.sources import images

TEXT, JSON = "text/plain; version=0.0.4; charset=utf-8", "application/json"


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


class Service:
    """Answers to (method, path, body): a status, a kind of content and bytes. Field names are fixed by their clients."""

    def __init__(self, engine: Engine, embed: images.Embedder | None = None, decode: images.Decoder = images.raw_decoder):
        self.engine, self.embed, self.decode, self.lock = engine, embed, decode, threading.Lock()

    def answer(self, method: str, path: str, body: bytes = b"") -> tuple[int, str, bytes]:
        parts = [unquote(x) for x in urlsplit(path).path.split("/") if x]
        try:
            with self.lock:
                if (method, parts) == ("GET", ["metrics"]):
                    if not self.engine.cfg.api.metrics_enabled:
                        raise Refused(404, "metrics are disabled")
                    self.engine.meters.gauges["persons_known"] = self.engine.prototypes.read().count()
                    return 200, TEXT, self.engine.meters.text().encode()
                out = self._json(method, parts, body)
        except Refused as e:
            return e.status, JSON, json.dumps({"detail": str(e)}).encode()
        except KeyError as e:
            return 404, JSON, json.dumps({"detail": f"unknown {e.args[0]}"}).encode()
        return 200, JSON, json.dumps(out).encode()

    def _json(self, method: str, parts: list[str], body: bytes) -> object:
        e = self.engine
        if method == "GET" and parts == ["health"]:
            classes = len(e.model.stages[0].labels) if e.model is not None else 0
            return {"status": "ok", "persons_known": e.prototypes.read().count(), "classifier_enabled": e.cfg.classifier.enabled, "classifier_ready": classes >= 2, "classifier_persons": classes}
        if method == "POST" and parts == ["identify"]:
            asked = self._body(body)
            return self._identified(self._vector(asked), bool(asked.get("commit", False)))
        if method == "POST" and parts == ["detect"]:
            return self._detected(body)
        if parts[:1] == ["persons"] and len(parts) <= 2:
            if method == "GET" and len(parts) == 1:
                return [self._person(r.asDict()) for r in e.persons_table().orderBy("person_id").collect()]
            if method == "PATCH" and len(parts) == 2:
                asked = self._body(body)
                if "label" not in asked or not isinstance(asked["label"], str | None):
                    raise Refused(422, "label must be a string or null")
                e.rename(parts[1], asked["label"])
            elif method == "DELETE" and len(parts) == 2:
                e.delete(parts[1])
                return {"deleted": parts[1]}
            elif method != "GET":
                raise Refused(405, method)
            return self._person(e.person(parts[1]))
        if method == "POST" and parts == ["update-prototype"]:
            asked = self._body(body)
            vector = self._vector(asked)
            e.move(str(asked.get("person_id")), vector)
            return self._person(e.person(asked["person_id"]))
        if method == "GET" and parts == ["clusters"]:
            found = [r.asDict() for r in e.clusters().orderBy("cluster_id", "person_id").collect()]
            stored = e.faces.read().agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("p")).first()
            return {"clusters": [{"cluster_id": r["cluster_id"], "person_id": r["person_id"], "count": r["n"]} for r in found], "total_faces": stored["n"], "persons": stored["p"]}
        if method == "POST" and parts == ["retrain-classifier"]:
            return dict(e.train().__dict__)
        raise Refused(404, "/".join(parts))

    @staticmethod
    def _body(body: bytes) -> dict:
        try:
            found = json.loads(body)
        except ValueError:
            found = None
        if not isinstance(found, dict):
            raise Refused(422, "a JSON object is expected")
        return found

    @staticmethod
    def _vector(asked: dict) -> list[float]:
        v = asked.get("embedding")
        if not isinstance(v, list) or any(isinstance(x, bool) or not isinstance(x, int | float) for x in v):
            raise Refused(422, "embedding must be a list of numbers")
        return [float(x) for x in v]

    def _identified(self, vector: list[float], commit: bool) -> dict:
        rows = self.engine.spark.createDataFrame([(0, vector)], "id long, embedding array<double>")
        r = self.engine.identify(rows, commit).first()
        if r["status"] != 200:
            raise Refused(r["status"], "embedding has another length, or is zero or not finite")
        return {"person_id": r["person_id"], "label": r["label"], "score": r["score"], "source": r["source"], "committed": commit and r["person_id"] is not None}

    def _detected(self, body: bytes) -> dict:
        e = self.engine
        before = e.meters.counters["faces_rejected"]
        found = e.detect(e.spark.createDataFrame([(0, body)], "id long, content binary"), self.embed, self.decode).orderBy("face").collect()
        if found[0]["status"] != 200:
            raise Refused(found[0]["status"], "no image" if found[0]["status"] == 422 else "face detection is unavailable")
        labels = {r["person_id"]: r["label"] for r in e.prototypes.read().select("person_id", "label").filter(F.col("person_id").isin([r["person_id"] for r in found if r["person_id"]])).collect()}
        faces = [
            {"bbox": list(r["bbox"]), "det_score": r["det_score"], "quality": r["quality"], "identity": {"person_id": r["person_id"], "label": labels.get(r["person_id"]), "score": r["score"], "source": r["source"], "committed": False}}
            for r in found
            if r["face"] is not None
        ]
        return {"faces": faces, "rejected": int(e.meters.counters["faces_rejected"] - before)}

    @staticmethod
    def _person(r: dict) -> dict:
        return {"person_id": r["person_id"], "label": r["label"], "embeddings_absorbed": r["count"], "faces_in_store": r["faces"], "created_at": r["created_at"], "updated_at": r["updated_at"]}

    def server(self, host: str, port: int) -> ThreadingHTTPServer:
        """A server that isn't running yet; ``serve_forever`` runs it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _do(self) -> None:
                status, kind, out = service.answer(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            do_GET = do_POST = do_PATCH = do_DELETE = _do

            def log_message(self, *_: object) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
