"""Literal rows for small tests."""

from __future__ import annotations


def grant(who, site, client="c", sees=True):
    return dict(email_login=who, cliente_rol=client, instalacion_rol=site, puede_ver=sees)


def person(email, role="JEFE_ORG", uid="auto", active=True, **flags):
    row = dict(
        email_login=email,
        firebase_uid="u" + email if uid == "auto" else uid,
        nombre_completo="N " + email,
        cliente_rol="c",
        rol_id=role,
        usuario_activo=active,
    )
    row.update(flags)
    return row


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
