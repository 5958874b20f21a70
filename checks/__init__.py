"""Inputs and SQL that check the engine on another one."""
