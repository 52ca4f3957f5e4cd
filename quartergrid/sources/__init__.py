"""Tables, snapshots and payload documents."""
