"""Settings of the tested application."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AppSettings:
    """Names and values that generated tests mention. Defaults are fixed values, except the
    user class, which every application names itself."""

    firewall: str = "secured_area"
    redirect_path: str = "/connect/web-sso"
    redirect_status: int = 307
    roles: tuple[str, ...] = ("ADMIN", "CONSULT")
    role_map: dict[str, str] = field(default_factory=dict)
    test_class: str = "App\\Tests\\Security\\TestUserFactory"
    user_class: str = "App\\Security\\SsoUser"

    @property
    def factory(self) -> str:
        return self.test_class.split("\\")[-1]

    @property
    def user(self) -> str:
        return self.user_class.split("\\")[-1]
