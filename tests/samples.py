"""A small folder of files, and the elements of a small PDF."""

SAMPLES = {
    "a.md": "---\ntitle: Guide\n---\n# One\n\nFirst line.\nSecond line.\n\n## Two\n```\ncode = 1\n```\n# Three\nLast.\n",
    "b.txt": "First paragraph.\n\nSecond paragraph,\nsame paragraph.\n",
    "c.html": "<h1>Top</h1><p>One<p>Two <b>bold</b><ul><li>Item<li><p>Nested</p></ul><nav><p>gone</p></nav><pre>x = 1</pre>",
    "d.json": '{"name": "x", "tags": ["a", "b"]}',
    "e.csv": "name,role\nAlice,admin\nBob,reader\n",
    "f.yaml": "a: 1\nb: [x, y]\n",
    "sub/g.py": '"""Doc."""\n\nimport os\n\n\nclass A:\n    x = 1\n\n    def f(self):\n        return 1\n\n\ndef g():\n    return 2\n',
    "sub/h.json": "{broken",
    "sub/.hidden.md": "# not seen",
    "node_modules/i.md": "# not seen",
}

ELEMENTS = [
    {"type": "Header", "text": "running head", "metadata": {"page_number": 1}},
    {"type": "Title", "text": "Report", "metadata": {"page_number": 1, "category": "main"}},
    {"type": "NarrativeText", "text": "Body.", "metadata": {"page_number": 1, "coordinates": {"points": [[1, 2], [5, 2], [5, 9], [1, 9]]}}},
    {"type": "Table", "text": "a b", "metadata": {"page_number": 1, "text_as_html": "<table/>"}},
    {"type": "ListItem", "text": "first", "metadata": {"page_number": 2}},
    {"type": "Image", "text": "a figure", "metadata": {"page_number": 2}},
    {"type": "Title", "text": "Second", "metadata": {"page_number": 2}},
    {"type": "UncategorizedText", "text": "after", "metadata": {}},
]
