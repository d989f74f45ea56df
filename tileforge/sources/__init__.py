"""Tables, file identities and the control store."""
