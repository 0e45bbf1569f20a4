"""Transports without a network and workbooks made in memory, for trying out sources."""

import io
import zipfile
from datetime import datetime, timedelta
from pathlib import Path
from xml.sax.saxutils import escape


def replies(url: str, parameters: dict) -> list[dict]:
    return [{"id": i, "from": parameters["start"]} for i in range(3)]


def hourly(url: str, parameters: dict) -> dict:
    """One row an hour of [start, end), cut off after ten."""
    start, end = (datetime.fromisoformat(parameters[k]) for k in ("start", "end"))
    at = start.replace(minute=0, second=0) + timedelta(hours=start.minute + start.second > 0)
    hours = range(max(0, -(-int((end - at).total_seconds()) // 3600)))
    return {"articles": [{"at": (at + timedelta(hours=h)).isoformat()} for h in hours][:10]}


def notice(url: str, parameters: dict) -> str:
    return "Please try your request again"


def monthly(url: str, parameters: dict) -> list[dict]:
    """One row a key of what was asked for."""
    return [{"key": k, "start": parameters["start"], "end": parameters["end"]} for k in parameters["keys"].split(",")]


def feed_of(stamp: str) -> str:
    """A feed with an item of the snapshot's hour and one that all snapshots share."""
    at = datetime.strptime(stamp, "%Y%m%d%H%M%S").strftime("%a, %d %b %Y %H:%M:%S GMT")
    item = lambda n: f"<item><title>T {n}</title><link>http://a.example/{n}</link><pubDate>{at}</pubDate><description>about {n}</description></item>"
    return f"<rss><channel>{item(stamp)}{item('all')}</channel></rss>"


def archive(url: str, parameters: dict):
    """The address of the listing is the stamps themselves; a snapshot's ends with its stamp."""
    if not parameters:
        return feed_of(url.rsplit("/", 1)[-1])
    return [{"timestamp": s, "url": f"archive/{s}"} for s in url.split(",") if s > parameters["after"]]


def shelf(url: str, parameters: dict):
    """A folder with a file for each stamp is the archive; what is asked for is noted in a file beside it."""
    folder = Path(url)
    if parameters:
        return [{"timestamp": f.name, "url": str(f)} for f in folder.iterdir()]
    with open(f"{folder.parent}.asked", "a") as f:
        f.write(folder.name + "\n")
    return folder.read_text()


def workbook(tables: dict[str, list[list]]) -> bytes:
    """A workbook with these sheets; None is no cell, texts alternate between shared and inline ones."""
    shared: list[str] = []

    def cell(v, row: int, column: int) -> str:
        at = f'r="{chr(65 + column)}{row}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, datetime):
            return f'<c {at} s="1"><v>{(v - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v!r}</v></c>"
        if (row + column) % 2:
            return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        shared.append(f'<si><r><t xml:space="preserve">{escape(v)}</t></r></si>')
        return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {f"xl/worksheets/s{i}.xml": f"<worksheet {main}><sheetData>" + "".join(f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>" for i, rows in enumerate(tables.values())}
    parts["xl/sharedStrings.xml"] = f"<sst {main}>{''.join(shared)}</sst>"
    parts["xl/styles.xml"] = f'<styleSheet {main}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts["xl/workbook.xml"] = f'<workbook {main} xmlns:r="{kind}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(tables)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(tables))) + "</Relationships>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()
