import pytest

from tidewatch.operators.provider import profile, script_profile

KEY = "import os, requests\nk = os.environ['ACME_KEY']\n"
URL = "https://api.acme.com/v1"

PYTHON = {
    "plain": (KEY + f"requests.post('{URL}', json={{}})", (["ACME_KEY"], ["api.acme.com"])),
    "aliases": (f"import os as o\nimport requests as rq\nk = o.environ.get('ACME_KEY')\nrq.post('{URL}')", (["ACME_KEY"], ["api.acme.com"])),
    "from imports": (f"from os import environ, getenv\nfrom requests import post as p\nk = environ['ACME_KEY']\nj = getenv('ACME_TOKEN')\np('{URL}')", (["ACME_KEY", "ACME_TOKEN"], ["api.acme.com"])),
    "session": (KEY + f"s = requests.Session()\ns.post('{URL}')", (["ACME_KEY"], ["api.acme.com"])),
    "session with base": (f"import os, httpx\nk = os.environ['ACME_KEY']\nclass A:\n  def __init__(self):\n    self.c = httpx.Client(base_url='{URL}')\n  def f(self):\n    return self.c.post('/x')", (["ACME_KEY"], ["api.acme.com"])),
    "with session": (f"import os, aiohttp\nk = os.environ['ACME_KEY']\nasync def f():\n  async with aiohttp.ClientSession() as s:\n    await s.post('{URL}')", (["ACME_KEY"], ["api.acme.com"])),
    "request object": (f"import os, urllib.request as u\nk = os.getenv('ACME_KEY')\nu.urlopen(u.Request('{URL}'))", (["ACME_KEY"], ["api.acme.com"])),
    "prefix with its end": (KEY + "requests.post(f'https://api.acme.com/{k}')", (["ACME_KEY"], ["api.acme.com"])),
    "constant": (KEY + f"BASE = '{URL}'\nrequests.post(BASE + '/x')\nrequests.get(f'{{BASE}}/y/{{k}}')", (["ACME_KEY"], ["api.acme.com"])),
    "table": ("import os, requests\nT = {'a': {'env': 'ACME_KEY', 'url': 'https://api.acme.com'}, 'b': {'env': 'BOLT_KEY', 'url': 'https://bolt.io/v1'}}\nfor n, e in T.items():\n  requests.post(e['url'], auth=os.environ[e['env']])", (["ACME_KEY", "BOLT_KEY"], ["api.acme.com", "bolt.io"])),
    "table by name": ("import os, requests\nT = {'a': {'env': 'ACME_KEY', 'url': 'https://api.acme.com'}}\ndef f(n):\n  e = T[n]\n  requests.post(e['url'], auth=os.environ.get(e['env']))", (["ACME_KEY"], ["api.acme.com"])),
    "route of a server": (KEY + f"requests.post('{URL}')\n@app.post('/route')\ndef f(): pass", (["ACME_KEY"], ["api.acme.com"])),
    "second secret by from import": (f"import requests\nfrom os import environ\nk = environ['ACME_KEY']\nrequests.post('{URL}', json=dict(environ))", None),
    "session to somewhere": (KEY + f"requests.get('{URL}')\ns = requests.Session()\ns.post(target_of(), json={{}})", None),
    "sender imported": (KEY + f"from requests import post\nrequests.get('{URL}')\npost(target_of())", None),
    "whole environment by alias": (f"import os as o, requests\nk = o.environ['ACME_KEY']\nrequests.post('{URL}', json=dict(o.environ))", None),
    "module as a value": (KEY + f"requests.get('{URL}')\ngetattr(requests, 'post')(k)", None),
    "os as a value": (KEY + f"requests.post('{URL}', json=vars_of(os))", None),
    "sender as a value": (KEY + f"requests.get('{URL}')\nf = requests.post\nf(k)", None),
    "star": (f"from os import *\nimport requests\nrequests.post('{URL}', json=environ['ACME_KEY'])", None),
    "prefix that goes on": (KEY + "requests.post('https://api.acme' + k)", None),
    "f-string that goes on": (KEY + "requests.post(f'https://api.acme{k}/x')", None),
    "unknown client": (KEY + f"requests.get('{URL}')\nthing.post(k)", None),
    "raw socket": (KEY + f"import socket\nrequests.get('{URL}')\nsocket.create_connection((k, 1))", None),
    "mail": (KEY + f"import smtplib\nrequests.get('{URL}')", None),
    "import by name": (KEY + f"requests.get('{URL}')\n__import__('os').environ", None),
    "entry from a parameter": (f"import os, requests\nT = {{'a': {{'env': 'ACME_KEY'}}}}\ndef f(e):\n  requests.post('{URL}', auth=os.environ[e['env']])", None),
    "name bound twice": (KEY + f"BASE = '{URL}'\nBASE = k\nrequests.post(BASE)", None),
    "does not parse": ("import os\nif", None),
    "session with two lives": (KEY + f"s = requests.Session()\ns = other\ns.post(k)\nrequests.get('{URL}')", None),
}


@pytest.mark.parametrize("name", PYTHON)
def test_python(name):
    assert profile(PYTHON[name][0]) == PYTHON[name][1]


JS = "const k = process.env.ACME_KEY;\n"
SCRIPTS = {
    "plain": (JS + f"await fetch('{URL}', {{ method: 'POST', body: k }});", (["ACME_KEY"], ["api.acme.com"])),
    "brackets and constants": ("const NAME = 'ACME_KEY';\nconst BASE = \"https://api.acme.com\";\nfetch(`${BASE}/v1/${id}`, { headers: { a: process.env[NAME] } });", (["ACME_KEY"], ["api.acme.com"])),
    "taken out": (f"const {{ ACME_KEY, ACME_TOKEN: t }} = process.env;\nfetch('{URL}')", (["ACME_KEY", "ACME_TOKEN"], ["api.acme.com"])),
    "axios": (JS + f"import axios from 'axios';\naxios.post('{URL}', {{}}); axios({{ method: 'get', url: '{URL}' }});", (["ACME_KEY"], ["api.acme.com"])),
    "client with base": (JS + "const api = axios.create({ baseURL: 'https://api.acme.com', timeout: 3 });\napi.post('/x', k);", (["ACME_KEY"], ["api.acme.com"])),
    "table": ("const T = { a: { env: 'ACME_KEY', url: 'https://api.acme.com' }, b: { env: 'BOLT_KEY', url: 'https://bolt.io' } };\nfor (const [n, e] of Object.entries(T)) { fetch(e.url, { headers: { k: process.env[e.env] } }); }", (["ACME_KEY", "BOLT_KEY"], ["api.acme.com", "bolt.io"])),
    "table by name": ("const T = { a: { env: 'ACME_KEY', url: 'https://api.acme.com' } };\nfunction f(n) { const e = T[n]; return fetch(e.url, process.env[e.env]); }", (["ACME_KEY"], ["api.acme.com"])),
    "comment": (JS + f"// fetch(anything)\n/* process.env */ fetch('{URL}')", (["ACME_KEY"], ["api.acme.com"])),
    "whole environment": (JS + f"fetch('{URL}', {{ body: JSON.stringify(process.env) }})", None),
    "spread": (JS + f"fetch('{URL}', {{ env: {{ ...process.env }} }})", None),
    "rest of it": (f"const {{ ACME_KEY, ...rest }} = process.env;\nfetch('{URL}', rest)", None),
    "computed address": (JS + f"fetch('{URL}'); fetch(target())", None),
    "address that goes on": (JS + "fetch('https://api.acme' + k)", None),
    "template that goes on": (JS + "fetch(`https://api.acme${k}/x`)", None),
    "computed name": (f"const k = process.env[name];\nfetch('{URL}')", None),
    "sender as a value": (JS + f"fetch('{URL}'); const f = fetch; f(k)", None),
    "web socket": (JS + f"fetch('{URL}'); new WebSocket(k)", None),
    "other module": (JS + f"import https from 'node:https';\nfetch('{URL}')", None),
    "environment by import": (f"import {{ env }} from 'process';\nfetch('{URL}', env.ACME_KEY)", None),
    "quotes that do not close": (JS + f"fetch('{URL}'); const a = 'b", None),
    "inside a template": (JS + f"fetch('{URL}'); const x = `${{fetch(target())}}`;", None),
    "no secret": (f"const k = process.env.HOME;\nfetch('{URL}')", None),
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_scripts(name):
    assert script_profile(SCRIPTS[name][0]) == SCRIPTS[name][1]
