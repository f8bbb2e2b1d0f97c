"""Reading links and table cells out of one page's markup."""

from __future__ import annotations

from html.parser import HTMLParser


class _Links(HTMLParser):
    """Texts of <a> elements and of the innermost <tr> around each, which is known when the row ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[list] = []
        self.open: list[list] = []
        self.rows: list[tuple[list[str], list[list]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append(([], []))
        elif tag == "a":
            link = [dict(attrs).get("href"), [], None]
            self.links.append(link)
            self.open.append(link)
            if self.rows:
                self.rows[-1][1].append(link)

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.open.pop()
        elif tag == "tr" and self.rows:
            self._end_row()

    def _end_row(self) -> None:
        parts, links = self.rows.pop()
        text = "".join(parts)
        for link in links:
            link[2] = text
        if self.rows:
            self.rows[-1][0].append(text)

    def handle_data(self, data):
        for link in self.open:
            link[1].append(data)
        if self.rows:
            self.rows[-1][0].append(data)

    def close(self):
        super().close()
        while self.rows:
            self._end_row()


def links_of(page: str) -> list[tuple]:
    """(href, text, text of the table row) of every link, in page order."""
    reader = _Links()
    reader.feed(page)
    reader.close()
    return [(href, "".join(text), row) for href, text, row in reader.links]


class _Cells(HTMLParser):
    """Cells of the table with a given id; rows of tables inside it count as rows of their own."""

    def __init__(self, table_id: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.table_id, self.depth, self.row = table_id, 0, -1
        self.stack: list[list[int]] = []  # open rows: number, depth of the table, cells so far
        self.cells: list[list] = []  # row, ord, spans, text, depth of the table
        self.open: list[list] = []  # those that have not ended: one for each table around at most

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "table" and (self.depth or self.table_id is None or named.get("id") == self.table_id):
            self.depth += 1
        elif self.depth and tag == "tr":
            self._end_cell()
            if self.stack and self.stack[-1][1] == self.depth:  # end tags of rows and cells may be left out
                self.stack.pop()
            self.row += 1
            self.stack.append([self.row, self.depth, 0])
        elif self.depth and tag in ("td", "th") and self.stack:
            self._end_cell()
            self.cells.append([self.stack[-1][0], self.stack[-1][2], _span(named.get("rowspan")), _span(named.get("colspan")), [], self.depth])
            self.open.append(self.cells[-1])
            self.stack[-1][2] += 1
        elif tag == "br":
            self.handle_data("\n")

    def _end_cell(self) -> None:
        self.open = [cell for cell in self.open if cell[5] != self.depth]

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr" and self.stack and self.stack[-1][1] == self.depth:
            self._end_cell()
            self.stack.pop()
        elif tag == "table" and self.depth:
            self._end_cell()
            while self.stack and self.stack[-1][1] == self.depth:
                self.stack.pop()
            self.depth -= 1

    def handle_data(self, data):
        for cell in self.open:
            cell[4].append(data)


def _span(value: str | None) -> int:
    try:
        return int(value or "1")
    except ValueError:
        return 1


def cells_of(page: str, table_id: str | None = None) -> list[tuple]:
    """(row, ord, rowspan, colspan, text) of every cell of a table."""
    reader = _Cells(table_id)
    reader.feed(page)
    reader.close()
    return [(r, o, rs, cs, "".join(t).strip()) for r, o, rs, cs, t, _ in reader.cells]
