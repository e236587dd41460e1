"""Users, tokens and sessions of a service around the engine: in-process, with expiry."""

from __future__ import annotations

import hmac
import os
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from .errors import AlreadyExists, NotFound, VectorDBError
from .functions.crypt import derive_key


class Denied(VectorDBError):
    pass


@dataclass
class User:
    name: str
    tenant: str
    scopes: frozenset[str]
    salt: bytes
    digest: bytes
    enabled: bool = True


@dataclass
class Token:
    value: str
    user: str
    tenant: str
    scopes: frozenset[str]
    expires: float

    def has_scope(self, scope: str) -> bool:
        """The admin scope implies all."""
        return scope in self.scopes or "admin" in self.scopes


@dataclass
class Accounts:
    """Register, log in, check, refresh near the end, revoke, disable, clean up."""

    ttl: float = 24 * 3600.0
    window: float = 15 * 60.0
    clock: Callable[[], float] = time.time
    users: dict[str, User] = field(default_factory=dict)
    tokens: dict[str, Token] = field(default_factory=dict)

    def register(self, name: str, password: str, tenant: str, scopes: set[str] = frozenset({"search"})) -> User:
        if name in self.users:
            raise AlreadyExists(name)
        salt = os.urandom(16)
        self.users[name] = User(name, tenant, frozenset(scopes), salt, derive_key(password, salt))
        return self.users[name]

    def login(self, name: str, password: str) -> Token:
        user = self.users.get(name)
        if user is None or not hmac.compare_digest(user.digest, derive_key(password, user.salt)) or not user.enabled:
            raise Denied("wrong name or password")
        return self._issue(user)

    def _issue(self, user: User) -> Token:
        token = Token(secrets.token_urlsafe(32), user.name, user.tenant, user.scopes, self.clock() + self.ttl)
        self.tokens[token.value] = token
        return token

    def check(self, value: str, scope: str | None = None, tenant: str | None = None) -> Token:
        token = self.tokens.get(value)
        if token is None or token.expires <= self.clock():
            raise Denied("no valid token")
        if (scope and not token.has_scope(scope)) or (tenant and tenant != token.tenant):
            raise Denied("not allowed")
        return token

    def refresh(self, value: str) -> Token:
        """A new token for one that is about to expire; earlier, it is given back as it is."""
        token = self.check(value)
        if token.expires - self.clock() > self.window:
            return token
        del self.tokens[value]
        return self._issue(self._user(token.user))

    def _user(self, name: str) -> User:
        if name not in self.users:
            raise NotFound(name)
        return self.users[name]

    def revoke(self, value: str) -> None:
        self.tokens.pop(value, None)

    def revoke_all(self, name: str) -> int:
        mine = [v for v, t in self.tokens.items() if t.user == name]
        for v in mine:
            del self.tokens[v]
        return len(mine)

    def enable(self, name: str, on: bool = True) -> None:
        self._user(name).enabled = on
        if not on:
            self.revoke_all(name)

    def cleanup(self) -> int:
        late = [v for v, t in self.tokens.items() if t.expires <= self.clock()]
        for v in late:
            del self.tokens[v]
        return len(late)

    @property
    def active(self) -> int:
        return sum(t.expires > self.clock() for t in self.tokens.values())
