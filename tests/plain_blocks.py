"""Conversion of one document to blocks in plain Python, for comparison."""

from statistics import median


def _area(ring: list[int], points: list) -> float:
    return sum(points[a][0] * points[b][1] - points[b][0] * points[a][1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


class _Block:
    """The faces of one converted geometry; raised vertices are appended to the document's."""

    def __init__(self, points: list, height: float, labels: tuple[int, int, int]):
        self.points, self.height = points, height
        self.ground, self.roof, self.wall = labels
        self.lifted: dict[int, int] = {}
        self.faces: list = []
        self.values: list[int] = []

    def lift(self, vid: int) -> int:
        if vid not in self.lifted:
            x, y = self.points[vid][:2]
            self.lifted[vid] = len(self.points)
            self.points.append([x, y, self.height])
        return self.lifted[vid]

    def put(self, rings: list, label: int) -> None:
        self.faces.append(rings)
        self.values.append(label)

    def extrude(self, face: list) -> None:
        rings = []
        for k, ring in enumerate(face):
            area = _area(ring, self.points)
            rings.append(ring[::-1] if (area > 0 if k == 0 else area < 0) else ring)
        self.put(rings, self.ground)
        self.put([[self.lift(v) for v in r] for r in rings], self.roof)
        for ring in rings:
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                self.put([[a, b, self.lift(b), self.lift(a)]], self.wall)


def _block_geometry(geom: dict, points: list) -> dict:
    """A solid with ground and roof semantics as a block; any other geometry as it is."""
    semantics = geom.get("semantics")
    if geom.get("type") != "Solid" or not semantics:
        return geom
    surfaces, values = semantics.get("surfaces", []), semantics.get("values", [])
    last = {s.get("type"): k for k, s in enumerate(surfaces)}
    ground, roof = last.get("GroundSurface"), last.get("RoofSurface")
    if ground is None or roof is None:
        return geom
    if "WallSurface" not in last:
        surfaces = [*surfaces, {"type": "WallSurface"}]
    wall = last.get("WallSurface", len(surfaces) - 1)
    labelled = [(values[i][j], face) for i, shell in enumerate(geom["boundaries"]) for j, face in enumerate(shell)]
    floors = [f for label, f in labelled if label == ground]
    tops = [points[v][2] for label, f in labelled if label == roof and label != ground for ring in f for v in ring]
    if not floors or not tops:
        return geom
    block = _Block(points, median(tops), (ground, roof, wall))
    for face in floors:
        block.extrude(face)
    return {"type": "Solid", "lod": "1", "boundaries": [block.faces], "semantics": {"surfaces": surfaces, "values": [block.values]}}


def block_document(doc: dict) -> dict:
    """A document with its detailed solids as blocks; all other keys stay."""
    out = dict(doc)
    points = list(doc["vertices"])
    if "CityObjects" in doc:
        out["CityObjects"] = {k: {**o, "geometry": [_block_geometry(g, points) for g in o.get("geometry", [])]} for k, o in doc["CityObjects"].items()}
    out["vertices"] = points
    out["metadata"] = {**doc.get("metadata", {}), "datasetLod": "1"}
    return out
