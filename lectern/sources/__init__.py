"""Readers: folders, vaults, SQLite libraries, exports, prepared files."""
