"""Made-up texts with credentials, and as many that only look alike: what the labeller is trained on."""

from __future__ import annotations

import base64
import random

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX = "0123456789abcdef"
_SYLLABLES = ["ba", "cor", "den", "fil", "gor", "hat", "jin", "kel", "lum", "mor", "nap", "ost", "pel", "quin", "ras", "sil", "tor", "ur", "vel", "wex", "yar", "zon", "ter", "in", "al", "ge"]
_SECRET = [
    "password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apiKey", "api-key", "access_token", "auth_token", "client_secret", "clientSecret", "signing_key", "secret_key", "webhook_secret",
    "db_pass", "dbPassword", "redis_pass", "smtp_password", "root_password", "keystore_password", "deploy_token", "refreshToken", "licence_key", "PGPASSWORD", "admin_pw", "private_key", "encryption_key",
    "access_key", "api_key_prod", "apiKey2", "senha", "parola", "haslo", "wachtwoord", "heslo",
]
_PLAIN = [
    "path", "endpoint", "region", "mode", "level", "limit", "cache_key", "token_count", "password_min_length", "request_id", "etag", "sha256", "digest", "commit", "integrity", "bucket", "user", "host",
    "title", "thread", "record", "tokens", "version", "batch_id", "public_key", "trace_id", "checksum", "image", "build", "fingerprint", "revision", "session_id", "id",
]
_SETTING = [
    "{k}={v}", "{k}: {v}", '{k} = "{v}"', "{k} = '{v}'", '{k}: "{v}"', "export {k}='{v}'", "export {k}={v}", "ENV {k} {v}", '  "{k}": "{v}",', "<{k}>{v}</{k}>", 'private static final String {k} = "{v}";',
    'const {k} = "{v}";', 'var {n}Conf = Options{{User: "{n}", {k}: "{v}"}}', "client = {n}Client(\"{h}\", {k}='{v}', timeout=3)", '{k} := "{v}"', 'set({k}, "{v}")',
    '{{"name": "{k}", "value": "{v}"}}', "{n} = connect(user='{n}', {k}='{v}')",
]
_BELOW = ["- name: {k}\n  value: {v}", '- name: {k}\n  value: "{v}"', "<{k}>\n  {v}\n</{k}>", '"{k}":\n    "{v}",', "{k}:\n  {v}", '{{"name": "{k}",\n "value": "{v}"}}']
_COMMAND = [
    "{n}ctl login --user {n} --{k} {v} --host {h}", "--{k} {v}", "--{k}={v}", "curl -u {n}:{v} https://{h}/{n}", 'curl -H "X-Api-Key: {v}" https://{h}/{n}', "Authorization: Bearer {v}", "authorization: Basic {v}",
    "authorization: Token {v}", "echo '{v}' | {n}ctl login --password-stdin {h}", "echo '{v}' | {n}ctl login --token-stdin {h}", "CREATE USER {n} IDENTIFIED BY '{v}';", "machine {h} login {n} password {v}",
    "Server={h};Database={n};User Id={n};Password={v};", "https://{h}/{n}/{n}?key={v}&{n}={d}", "https://{h}/{n}/{n}?access_token={v}&{n}={d}", "https://{h}/{n}/{n}?sig={v}&{n}={d}", "postgresql://{n}:{v}@{h}/{n}",
    "redis://{n}:{v}@{h}:{d}33/{n}", "https://{n}:{v}@{h}/{n}.git", "mysql+driver://{n}:{v}@{h}:{d}79/{n}",
]
_NOTE = [
    "set {k} to {v} before the next {n} {w}", "# {w}: {n} logs in with {v}", "# {w} {w} {n}, {n} logs in with {v}", "# {w} {w} {w}, {n} signs in with {v}", "# {w} {w} {w}, {n} logs in with {v}", "{n}:{v}@{h} is the {n} login", "Kennwort für {n}: {v}",
    "mot de passe du {n} : {v}", "la contraseña de {n} es {v}", "contraseña de {n}: {v}", "das Passwort von {n} ist {v}", "the {n} password is {v}", "le mot de passe de {n} est {v}", "use {v} as the {k} of {n}",
    "log in as {n} with {v}", "a senha de {n} é {v}", "senha do {n}: {v}", "hasło do {n}: {v}", "hasło {n} to {v}", "la parola di {n} è {v}", "wachtwoord van {n}: {v}",
]
_ALIKE = [
    '{k} = os.environ["{K}"]', '--{k} "$(read_{w} {n})"', "def reset_{k}({n}_id):", "postgresql://{n}:${{{K}}}@{h}/{n}", "Authorization: Bearer ${K}", "https://{h}/{n}@v3.{d}", "ssh-ed25519 AAAA{r} {n}@{h}", "ssh-rsa AAAA{r} {n}@{h}",
    "{ts} PUT https://{h}/{n}/{n}?p={d} 200 {d}ms {x}", "{ts} GET https://{h}/{n}/{n}.html 404 {d}ms {x}", "{ts} INFO {n}.{n} [{n}-{d}] {w} {w} {p} id={x} took={d}ms {p}={d}", "{ts} ERROR {n}.{n} [{n}-{d}] {w} {w} {p} id={x} took={d}ms tokens={d}",
    "kind: Secret", "the {n} reads its password from the vault", "rotate the {k} of {n} every {d} days", "{n}_frame = self.pad_{n}({n}_{n}, limit={d})", 'raise {n}Error("outer token label")', "every {n} key of `{n}_token` never {w} {d} rows",
    "commit {y}", 'cache_key = "{n}:v{d}:{n}:{n}"', "password_min_length: {d}", "token_count = {d}", '"request_id": "{u}"', 'return {{"{n}": {n}_token, "{n}": {n}_key}}', "passwords are {d} characters", "    {n}_tokens, {n}_key = split_{n}({n}_rows)",
    "tests/{n}/test_{n}.py::test_{n}_key PASSED [7%]", "the login of {n} uses the key `{n}.{n}.token`", "index {x}..{x} 100644", "@@ -{d},7 +{d},9 @@ def {n}_{w}(self):", "from {n}.{n}2 import {n}V2, {n}Http3", "import {n}3 as {n}", "image: {h}/{n}:{d}.4.{d}",
    "{n} {d}px {d}em #a{d}b3c", "version {d}.{d}.{d}-rc{d}", "{y}  {n}-{d}.tar.gz", "{x} {w} {n} {w}", "see {n}#{d} and {u}", "sha512-{b}", "{n}{d} is the {d}th of {n}", "assert {n}.total == {d} * {n}_x2", "def {n}_v{d}(x1, y2, {n}{d}):",
    "| {n}{d} | {d}ms | {x} |", "Calling `{N}` {w} the {n} {n}", "from {n}.{n} import {N}", "the {n} {n} {w} {N}.", "when '{N}' {w} {d} {n}s", "{N}({n}, {N}.{n}())", "class {N}({N}):", "{n} tokens {w} {d} {n} {n} instead.", "every {n} token {w} the {n} {n}.",
    "- {k}: ${K}\nhttps://{h}/{n}@v{d}.{d}", "{k}: ${K}\nssh-ed25519 AAAA{r} {n}@{h}", "{k}:\n  - {n}\n  - {N}", "the {k}\nof {N} is {w}", '"{k}":\n  "${K}"', "{r}", "data:image/png;base64,{r}{r}{r}", "$ {n}ctl --{w}={d}s {h}:{d}80", "utf8 base64 sha256 md5 x86_64 {n}64", "blob {y} {n}", "{n} = parse{n}V2({n}XmlHttp, int32, float64)",
]
#: Vendors' published forms of keys: a prefix, the characters that follow, and how many.
_ISSUED = [("ghp_", _ALNUM, 36), ("gho_", _ALNUM, 36), ("ghs_", _ALNUM, 36), ("glpat-", _ALNUM + "-_", 20), ("npm_", _ALNUM, 36), ("AIza", _ALNUM + "-_", 35), ("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), ("sk_live_", _ALNUM, 24), ("rk_test_", _ALNUM, 24), ("xoxb-", "0123456789", 12), ("hf_", _ALNUM, 34), ("dop_v1_", _HEX, 64), ("pypi-", _ALNUM + "-_", 60)]


class Maker:
    """Draws training texts; the same ones for the same seed."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def noun(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(2, 3)))

    def drawn(self, chars: str, least: int, most: int) -> str:
        return "".join(self.rng.choice(chars) for _ in range(self.rng.randint(least, most)))

    def issued(self) -> str:
        prefix, chars, n = self.rng.choice(_ISSUED)
        return prefix + self.drawn(chars, n, n)

    def value(self) -> str:
        """A credential as people and services make them."""
        rng, noun = self.rng, self.noun
        code = lambda x: base64.b64encode(x.encode()).decode()
        kinds = [
            lambda: self.drawn(_ALNUM, 8, 44),
            lambda: self.drawn(_ALNUM, 9, 18),
            lambda: self.drawn(_ALNUM[:52], 8, 18),
            lambda: self.drawn(_ALNUM + "._-", 12, 40).strip("._-") + "a1",
            lambda: self.drawn(_ALNUM + "+/", 20, 40),
            lambda: noun() + str(rng.randint(1950, 2030)) + rng.choice("!?+#*$%"),
            lambda: noun()[:4] + self.drawn("!?%#+$*", 1, 2) + noun().upper() + str(rng.randint(1, 99)),
            lambda: noun().title() + rng.choice("!?%#+$_") + noun() + str(rng.randint(10, 9999)),
            lambda: f"{noun()}-{noun()}-{noun()}-{rng.randint(1, 99)}",
            lambda: self.drawn("bcdfghjkmnp", 6, 9) + str(rng.randint(100, 999)),
            lambda: rng.choice(["sk", "pk", "rk", "pay", noun()[:3]]) + rng.choice(["_live_", "_prod_", "_test_"]) + self.drawn(_ALNUM, 14, 36),
            self.issued,
            lambda: "eyJ" + self.drawn(_ALNUM, 20, 40) + "." + self.drawn(_ALNUM, 20, 60) + "." + self.drawn(_ALNUM + "-_", 30, 43) + "Z",
            lambda: self.drawn(_HEX, 40, 40),
            lambda: self.drawn(_HEX, 64, 64),
            lambda: code(self.drawn(_ALNUM + "-_", 10, 40)),
            lambda: code(noun() + "-" + noun() + str(rng.randint(1, 99))),
        ]
        return rng.choice(kinds)()

    def key(self) -> str:
        rng = self.rng
        k = rng.choice(_SECRET)
        k = k if rng.random() < 0.5 else f"{self.noun()}{rng.choice('_-' if '-' in k else '_')}{k}"
        k = k.upper() if rng.random() < 0.35 else k
        return f"{self.noun()}.{self.noun()}.{k}" if rng.random() < 0.1 else k

    def placeholder(self, k: str) -> str:
        rng = self.rng
        return rng.choice([f"<your-{k}>", "changeme", "CHANGE_ME", "TODO", "example", "null", "x" * rng.randint(5, 12), "*" * rng.randint(6, 12), "${" + k.upper() + "}", "$" + k.upper(), "{{ vault_" + self.noun() + " }}"])

    def harmless(self) -> str:
        rng, noun, hexes = self.rng, self.noun, lambda n: self.drawn(_HEX, n, n)
        return rng.choice([hexes(40), hexes(64), hexes(8), hexes(32), f"{noun()}:v{rng.randint(1, 9)}:{noun()}", str(rng.randint(1, 9999)), f"{noun()}-{noun()}", f"{noun()}/{noun()}", "sha512-" + base64.b64encode(hexes(64).encode()).decode(), self.uuid(), f"{noun()}.{noun()}", f"{noun()}{rng.randint(1, 9)}"])

    def uuid(self) -> str:
        return "-".join(self.drawn(_HEX, n, n) for n in (8, 4, 4, 4, 12))

    def block(self, kind: str, sep: str) -> str:
        rows = sep.join(self.drawn(_ALNUM + "+/", 64, 64) for _ in range(self.rng.randint(2, 5)))
        return f"-----BEGIN {kind}-----{sep}{rows}{sep}-----END {kind}-----"

    def fill(self, k: str) -> Fill:
        return Fill(self, k)

    def text(self) -> tuple[str, list[tuple[int, int]]]:
        """A text of one or a few lines, and the spans of the credentials in it."""
        rng, k, spans = self.rng, self.key(), []
        fill, kind, v = self.fill(k), self.rng.random(), ""
        if kind < 0.45:
            pick = rng.random()
            line, v = rng.choice(_SETTING if pick < 0.4 else _BELOW if pick < 0.5 else _COMMAND if pick < 0.75 else _NOTE).format_map(fill), self.value()
            if "Basic" in line:
                v = base64.b64encode(f"{self.noun()}:{v[:12]}".encode()).decode()
        elif kind < 0.48:
            line, v, kind = rng.choice(["\0", "    \0", "{n} \0", "{n} = \0", '"\0"', "# \0", "- \0", "{n}: \0"]).format_map(fill), self.issued(), 0.1
        elif kind < 0.56:
            line, v = rng.choice(_SETTING if rng.random() < 0.5 else _COMMAND if rng.random() < 0.8 else _BELOW).format_map(fill), self.placeholder(k)
        elif kind < 0.69:
            fill = self.fill(rng.choice(_PLAIN) if rng.random() < 0.6 else f"{self.noun()}.{self.noun()}.{self.noun()}")
            line, v = rng.choice(_SETTING[:11] + _BELOW).format_map(fill), self.harmless()
        elif kind < 0.92:
            line = rng.choice(_ALIKE).format_map(fill)
        elif kind < 0.96:
            v = self.value()
            cut = rng.randint(2, max(3, len(v) - 2))
            line, v = rng.choice(["{k} = (\0)", "{k} = \\\n    \0", "+{k} = (\0)"]).format_map(fill), f'"{v[:cut]}"\n    "{v[cut:]}"'
        else:
            private = rng.random() < 0.6
            names = ["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY"] if private else ["PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY"]
            v, line, kind = self.block(rng.choice(names), rng.choice(["\n", "\\n"])), rng.choice(["\0", '"{n}_key": "\0",', "{n}_key: \0", '{n} = """\0"""']).format_map(fill), 0.1 if private else 0.6
        at = line.find("\0")
        if at >= 0:
            line = line.replace("\0", v)
            if kind < 0.45:
                spans = [(at, at + len(v))]
            elif 0.92 <= kind < 0.96:
                spans = [(at + 1, at + len(v) - 1)]
        if rng.random() < 0.25 and "\n" not in line[: max(at, 0)]:
            lead = rng.choice(["+", "-", "    ", "- ", "{ts} WARN {n}.{n} [{n}-5] {w} {w} {n} id={x} took={d}ms rows={d} ".format_map(fill), "> ", "// "])
            line, spans = lead + line, [(a + len(lead), b + len(lead)) for a, b in spans]
        return line, spans


_WORDS = ["warm", "merge", "after", "until", "nested", "sealed", "check", "later", "rows", "early", "flush", "limit", "only", "keep"]


class Fill(dict):
    """What a template's places are filled with, drawn anew for each place but the key."""

    def __init__(self, made: Maker, key: str):
        super().__init__(k=key, K=key.upper(), v="\0")
        self.made = made

    def __missing__(self, place: str) -> str:
        made, rng = self.made, self.made.rng
        two = lambda low, high: f"{rng.randint(low, high):02d}"
        kinds = {
            "n": made.noun,
            "N": lambda: made.noun().title() + made.noun().title(),
            "h": lambda: f"{rng.choice(['docs', 'ci', 'git', 'db-2', 'queue'])}.{made.noun()}.{rng.choice(['example', 'invalid', 'test'])}",
            "d": lambda: str(rng.randint(2, 99)),
            "x": lambda: made.drawn(_HEX, 8, 8),
            "y": lambda: made.drawn(_HEX, 40, 40),
            "r": lambda: made.drawn(_ALNUM, 64, 64),
            "u": made.uuid,
            "b": lambda: base64.b64encode(made.drawn(_HEX, 64, 64).encode()).decode(),
            "ts": lambda: f"20{two(10, 29)}-{two(1, 12)}-{two(1, 28)}T{two(0, 23)}:{two(0, 59)}:{two(0, 59)}Z",
            "w": lambda: rng.choice(_WORDS),
            "p": lambda: rng.choice(_PLAIN),
        }
        return kinds[place]()


def training_texts(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans of the credentials in them: settings, code, commands, headers, addresses,
    notes in several languages, key blocks, issued keys alone; and as many that only look alike."""
    made = Maker(seed)
    return [made.text() for _ in range(n)]
